"""The chunk table of ``documents`` and its inverted index, kept up to date with the files.

Each use compares the files of ``documents`` (paths, lengths, times) with those that the
tables were made from. Where there are new ones, the books that they add to are written
again, positions and all, as a new generation beside the old: a book's rows are those of its
latest generation, so frames planned before stay valid. Where files went or changed, or half
the books or many generations would be stale, all is made anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chunk_key, tokens
from ..operators import postings
from ..operators.running import running
from ..sources.workspace import stored, work_dir

CHUNKS_SCHEMA = "doc_id long, series_id int, chapter_number int, level int, chunk_index int, text string, lang string, is_summary boolean, chunk_key string, book_position double, tokens array<string>, book_number int"
#: So many generations are kept side by side.
GENERATIONS = 6
#: Characters of a book in a part, which a task numbers, sorts and writes.
PART = 16 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """What Spark lists below a path; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", "length", "modificationTime")


def mark_of(listed: DataFrame) -> tuple:
    """Number and hash of listed files."""
    file = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return tuple(listed.agg(F.count("*"), F.coalesce(F.bit_xor(file), F.lit(0)), F.coalesce(F.sum(file.cast("decimal(20,0)")), F.lit(0))).first())


@dataclass
class Shelf:
    """Stored generations of one folder's chunks; ``books`` of each that a later one replaces are skipped."""

    spark: SparkSession
    source: str
    root: str = ""
    mark: tuple | None = None
    generations: list[list[int]] = field(default_factory=list)  # books that each wrote
    tokenised: bool = False
    made: dict[str, tuple] = field(default_factory=dict)  # what others keep beside it: name -> (marks, value)

    def _part(self, name: str, schema: str, skip: bool = True) -> DataFrame:
        out = None
        for g in range(len(self.generations)):
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/generation-{g}/{name}")
            later = sorted({b for books in self.generations[g + 1 :] for b in books})
            if skip and later:
                rows = rows.filter(~F.col("book_number").isin(later))
            out = rows if out is None else out.unionByName(rows)
        return out

    def chunks(self) -> DataFrame:
        return self._part("chunks", CHUNKS_SCHEMA)

    def index(self) -> postings.Index:
        """Written when it's first asked for, and with each generation from then on."""
        if not self.tokenised:
            for g in range(len(self.generations)):
                self._write_index(g)
            self.tokenised = True
        return postings.Index(
            self._part("postings", postings.POSTINGS), self._part("words/vocabulary", postings.VOCABULARY, skip=False), self._part("words/neighbours", postings.NEIGHBOURS, skip=False)
        )

    def refresh(self) -> None:
        listed = files(self.spark, self.source)
        mark = mark_of(listed)
        if mark == self.mark:
            return
        new = None
        if self.mark is not None and len(self.generations) < GENERATIONS:
            known = self._manifest()
            same = ["path", "length", "modificationTime"]
            if known.join(listed, same, "left_anti").isEmpty():
                new = [r["path"] for r in listed.join(known, same, "left_anti").select("path").collect()]  # the files of one ingest
        if new is None or not self._append(new):
            self._rebuild()
        listed.withColumn("generation", F.lit(len(self.generations) - 1)).write.mode("overwrite").parquet(f"{self.root}/files-{len(self.generations)}")
        self.mark = mark

    def _manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/files-{len(self.generations)}").drop("generation")

    def _rebuild(self) -> None:
        docs = self.spark.read.parquet(self.source)
        self.root, self.generations, tokenised, self.tokenised = work_dir(self.spark), [], self.tokenised, False
        sources = docs.select("source").distinct()
        first = Window.orderBy(F.col("source").isNull(), F.length("source"), "source")  # a row a book
        sources.select("source", F.row_number().over(first).alias("book_number")).write.parquet(f"{self.root}/books-0")
        self._write(docs, self._books(0))
        if tokenised:
            self.index()

    def _books(self, g: int) -> DataFrame:
        return self.spark.read.schema("source string, book_number int").parquet(f"{self.root}/books-{g}")

    def _append(self, files: list[str]) -> bool:
        """The books of new files as a new generation; False where making all anew is due."""
        g = len(self.generations)
        grown = self.spark.read.schema(self.spark.read.parquet(self.source).schema).parquet(*files).select("source").distinct()
        known = self._books(g - 1)
        fresh = grown.join(known, grown["source"].eqNullSafe(known["source"]), "left_anti")
        last = known.agg(F.coalesce(F.max("book_number"), F.lit(0))).first()[0]
        first = Window.orderBy(F.col("source").isNull(), F.length("source"), "source")
        known.unionByName(fresh.select("source", (F.row_number().over(first) + last).alias("book_number"))).write.mode("overwrite").parquet(f"{self.root}/books-{g}")
        books = self._books(g)
        changed = books.join(grown.select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if 2 * changed.count() > books.count():
            return False
        docs = self.spark.read.parquet(self.source)
        touched = docs.join(F.broadcast(changed.select(F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s")), "left_semi")  # books of one ingest
        self._write(touched, changed)
        return True

    def _write(self, docs: DataFrame, books: DataFrame) -> None:
        """Chunks of whole books: a source is a book, a document is a chapter of one chunk.

        Narrow rows are counted over ranges, and give the bounds of parts of bounded size and
        what comes before each. So texts are moved and sorted once, by part, and numbered on
        from its start. The table is in folders by book and sorted by chapter, so that guards
        prune folders and row groups. Documents of equal ids go by their texts' hashes; wholly
        equal ones share a number.
        """
        g = len(self.generations)
        names = F.broadcast(books.select(F.col("source").alias("__b"), "book_number"))
        numbered = docs.join(names, F.col("source").eqNullSafe(F.col("__b"))).select("doc_id", "text", "lang", "book_number", F.xxhash64("text", "lang").alias("__h"))
        chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__chars")
        narrow = numbered.select("book_number", "doc_id", "__h", F.lit(1).alias("__one"), chars).distinct()
        placed = running(narrow, ["book_number"], ["doc_id", "__h"], {"__n": "__one", "__to": "__chars"})
        start = F.col("__to") - F.col("__chars")
        cut = placed.groupBy(F.col("book_number").alias("__book"), F.floor(start / PART).alias("__part")).agg(
            F.min(F.struct("doc_id", "__h")).alias("__from"), F.min("__n").alias("__first"), F.min(start).alias("__before"), F.first("__to_total").alias("__all"),
        )
        order = Window.orderBy("__book", "__part")  # a row a part
        bounds = stored(cut.withColumns({"__until": F.lead("__from").over(Window.partitionBy("__book").orderBy("__part")), "__task": (F.row_number().over(order) - 1).cast("int")}))
        at = F.struct("doc_id", "__h")
        inside = (F.col("book_number") == F.col("__book")) & (at >= F.col("__from")) & (F.col("__until").isNull() | (at < F.col("__until")))
        dealt = numbered.join(F.broadcast(bounds), inside).repartitionById(max(1, bounds.count()), F.col("__task"))
        part = Window.partitionBy("book_number", "__task").orderBy("doc_id", "__h")
        fresh = ~F.coalesce(F.lag(at).over(part).eqNullSafe(at), F.lit(False))
        counted = dealt.select("*", fresh.alias("__fresh"), chars).select("*", F.dense_rank().over(part).alias("__n"), F.sum(F.when(F.col("__fresh"), F.col("__chars")).otherwise(0)).over(part.rowsBetween(Window.unboundedPreceding, 0)).alias("__to"))
        rows = counted.select(
            "doc_id", F.lit(1).alias("series_id"), "book_number", (F.col("__first") + F.col("__n") - 2).cast("int").alias("chapter_number"), F.lit(1).alias("level"), F.lit(0).alias("chunk_index"),
            F.coalesce("text", F.lit("")).alias("text"), "lang", F.lit(False).alias("is_summary"), F.round(F.try_divide(F.col("__before") + F.col("__to"), "__all"), 4).alias("book_position"),
        )
        rows = rows.withColumns({"chunk_key": chunk_key(*(F.col(c) for c in postings.KEY)), "tokens": tokens(F.col("text"))})
        rows.write.mode("overwrite").partitionBy("book_number").parquet(f"{self.root}/generation-{g}/chunks")
        self.generations.append([r[0] for r in books.select("book_number").collect()])  # a number a book
        if self.tokenised:
            self._write_index(g)

    def _write_index(self, g: int) -> None:
        at = f"{self.root}/generation-{g}"
        postings.write_postings(self.spark.read.schema(CHUNKS_SCHEMA).parquet(f"{at}/chunks"), f"{at}/postings")
        earlier = [self.spark.read.schema(postings.VOCABULARY).parquet(f"{self.root}/generation-{i}/words/vocabulary") for i in range(g)]
        known = None
        for part in earlier:
            known = part if known is None else known.unionByName(part)
        postings.write_vocabulary(self.spark.read.schema(postings.POSTINGS).parquet(f"{at}/postings"), f"{at}/words", known)


_shelves: dict[tuple[str, str], Shelf] = {}


def shelf(spark: SparkSession, sf_dir: str) -> Shelf:
    """The tables of a folder, brought up to date."""
    known = (spark.sparkContext.applicationId, sf_dir)
    found = _shelves.setdefault(known, Shelf(spark, f"{sf_dir}/documents.parquet"))
    found.refresh()
    return found
