"""Writers: chunk trees, idempotent appends, conversations, feedback, reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.conversation import TTL_SECONDS, feedback_line
from ..operators.running import running

#: Characters of text in a file of a chunk tree (one chunk at least).
TREE_PART = 4 << 20
REQUIRED = ("series_id", "book_number", "chapter_number", "level", "chunk_index", "book_filename", "is_summary", "full_chunk")


def normalised(chunks: DataFrame, series_id: int) -> DataFrame:
    """Keys with their series, ``document`` in lower case, the raw text in ``full_chunk``, edges joined by commas."""
    key = F.when(F.col("chunk_key").startswith("series_"), F.col("chunk_key")).otherwise(F.concat(F.lit(f"series_{series_id}|"), "chunk_key"))
    return chunks.withColumns({"chunk_key": key, "document": F.lower("text"), "full_chunk": F.col("text"), "parents": F.array_join("parents", ","), "children": F.array_join("children", ",")})


def check_complete(chunks: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The chunks; a ValueError names columns that hold a null."""
    there = [c for c in columns if c in chunks.columns]
    bad = chunks.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in there]).first().asDict()
    if wrong := sorted(c for c, x in bad.items() if x):
        raise ValueError(f"null values in: {', '.join(wrong)}")
    return chunks


def only_new(new: DataFrame, existing: DataFrame, key: str = "chunk_key") -> DataFrame:
    """New rows whose key isn't there yet; one per key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_new(new: DataFrame, existing: DataFrame, path: str) -> None:
    """Append what is new to a Parquet store partitioned by series and book."""
    only_new(new, existing).write.mode("append").partitionBy("series_id", "book_number").parquet(path)


def chunk_json(chunks: DataFrame, metadata: tuple[str, ...]) -> Column:
    """Column: a chunk as JSON with its metadata, nulls kept."""
    return F.to_json(F.struct("chunk_key", "text", F.struct(*[c for c in metadata if c in chunks.columns]).alias("metadata")), {"ignoreNullFields": "false"})


def write_chunk_tree(chunks: DataFrame, path: str, compress: bool = True) -> None:
    """A folder per book with files of one line: {book_file: {chapter: {level: [chunk, ...]}}}.

    A book of more than TREE_PART characters is cut, in order of its chapters, levels and
    chunks, into trees of that size, a file each: together they are the book's tree, and no
    row, task or reader holds it whole. A book whose first chapter has no level 1 is skipped.
    """
    first = chunks.groupBy("book_filename", "book_number", "chapter_number").agg(F.bool_or(F.col("level") == 1).alias("__one"))
    per = ["book_filename", "book_number"]
    kept = first.groupBy(*per).agg(F.min_by("__one", "chapter_number").alias("__ok")).filter("__ok").select(*[F.col(c).alias(f"__{c}") for c in per])
    place = ["chapter_number", "level", "chunk_index"]
    sizes = chunks.groupBy(*per, *place).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("__chars"))
    placed = running(sizes, per, place, {"__to": "__chars"})
    cut = placed.select(*[F.col(c).alias(f"__{c}") for c in per + place], F.floor((F.col("__to") - F.col("__chars")) / TREE_PART).alias("__part"))
    cut = cut.groupBy(*[f"__{c}" for c in per], "__part").agg(F.min(F.struct(*[f"__{c}" for c in place])).alias("__from"))
    cut = cut.withColumn("__until", F.lead("__from").over(Window.partitionBy(*[f"__{c}" for c in per]).orderBy("__part")))  # a row a file
    cut = cut.join(kept.select(*[F.col(f"__{c}").alias(f"__k{c}") for c in per]), [F.col(f"__{c}").eqNullSafe(F.col(f"__k{c}")) for c in per], "left_semi")
    at = F.struct(*place)
    inside = [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in per], at >= F.col("__from"), F.col("__until").isNull() | (at < F.col("__until"))]
    chunks = chunks.join(F.broadcast(cut), inside)
    per = [*per, "__part"]
    fields = ["text", "metadata", "is_summary", "embedding", "chunk_key", "parents", "children"]
    meta = F.struct(*[c for c in ("series_id", "book_number", "chapter_number", "level", "chunk_index", "book_position", "book_filename", "full_chunk", "is_summary") if c in chunks.columns])
    keyed = chunks.withColumn("metadata", meta)
    node = F.struct(*[c for c in fields if c in keyed.columns])
    by_number = lambda a, b: F.when(a["__n"] < b["__n"], -1).when(a["__n"] > b["__n"], 1).otherwise(0)  # noqa: E731  maps have no order
    ordered = lambda name: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("__n", name, "__v")), by_number), lambda x: F.struct(x[name], x["__v"])))
    per_level = keyed.groupBy(*per, "chapter_number", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", node.alias("n")))), lambda x: x["n"]).alias("__v"))
    per_level = per_level.withColumns({"level_name": F.concat(F.lit("level_"), "level"), "__n": F.col("level")})
    per_chapter = per_level.groupBy(*per, "chapter_number").agg(ordered("level_name").alias("__v"))
    per_chapter = per_chapter.withColumns({"chapter": F.concat(F.lit("chapter_"), "chapter_number"), "__n": F.col("chapter_number")})
    per_book = per_chapter.groupBy(*per).agg(ordered("chapter").alias("__v"))
    line = F.to_json(F.map_from_arrays(F.array("book_filename"), F.array("__v")))
    per_book.select("book_number", line.alias("value")).write.mode("overwrite").partitionBy("book_number").option("compression", "gzip" if compress else "none").option("maxRecordsPerFile", 1).text(path)


def append_conversation(turns: DataFrame, path: str, now: Column, ttl: int = TTL_SECONDS) -> None:
    """Append turns with their times; the latest write of a conversation renews all of it on reading."""
    turns.withColumns({"ts": now, "expires_at": F.timestamp_seconds(F.unix_seconds(now) + ttl)}).write.mode("append").parquet(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    """``id|feedback|type`` lines in a folder per day."""
    rows.select(F.to_date("ts").alias("day"), feedback_line(F.col("request_id"), F.col("feedback"), F.col("kind")).alias("value")).write.mode("append").partitionBy("day").text(path)


def prune_feedback(spark: SparkSession, path: str, keep: int = 30) -> list[str]:
    """Delete all but the last ``keep`` days of a feedback folder; gives the days that went."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(x.getPath().getName() for x in store.listStatus(folder) if x.isDirectory() and x.getPath().getName().startswith("day="))
    gone = days[: max(0, len(days) - keep)]
    for day in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}"), True)
    return [d.removeprefix("day=") for d in gone]


def quality_matrix(answers: DataFrame, books: list[int]) -> DataFrame:
    """A row per question, a column per book: the first answer in order of ``chunk_key``."""
    cells = [F.min_by(F.when(F.col("book_number") == b, F.col("answer")), F.when(F.col("book_number") == b, F.col("chunk_key"))).alias(f"book_{b}") for b in books]
    return answers.filter(reduce(or_, [F.col("book_number") == b for b in books], F.lit(False))).groupBy("question").agg(*cells)


def matrix_html(rows: list[dict], title: str = "Answers by book") -> str:
    """A page with a row per question and a column per book, of a matrix small enough to read."""
    from html import escape

    heads = list(rows[0]) if rows else ["question"]
    cell = lambda tag, x: f"<{tag}>{escape('' if x is None else str(x))}</{tag}>"
    lines = ["<tr>" + "".join(cell("th", h) for h in heads) + "</tr>", *("<tr>" + "".join(cell("td", r[h]) for h in heads) + "</tr>" for r in rows)]
    return f"<!DOCTYPE html><title>{escape(title)}</title><table>" + "".join(lines) + "</table>"
