"""A positional inverted index beside the chunk table, and the searches that read it.

A posting is a token of a chunk with all its positions. Postings lie in folders by a bucket
of the token, sorted by token, so a search reads the folders and row groups of its words and
no text. They carry what guards look at, so a guard is applied to them as to chunks. Beside
them lie the vocabulary, in folders by length, and a table of segments: a token of at most
``NEAR_LENGTH`` characters that resembles words within k edits is cut into k + 1 segments, and
one of them stands in each such word, at most k places off. A fuzzy search looks the parts of
its misspelt word up there, weighs the tokens found, and reads their postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_key
from .search import MAX_RESULTS, THRESHOLD, WINDOW, Strategy, best_first, keywords, near_words, phrases

BUCKETS = 32
#: A length's part of the vocabulary is dealt to so many tasks.
PARTS = 8
#: Bytes of the chunk table that a task reads to write its postings.
SPLIT = 32 << 20
#: What a posting says of its chunk.
PLACE = ("series_id", "book_number", "chapter_number", "level", "chunk_index", "book_position", "is_summary", "lang")
POSTINGS = "token string, size int, positions array<int>, spaced array<int>, series_id int, book_number int, chapter_number int, level int, chunk_index int, book_position double, is_summary boolean, lang string, bucket int"
VOCABULARY = "token string, length int"
NEIGHBOURS = "variant bigint, token string, bucket int"
#: Words of up to WORD_LENGTH characters resemble only tokens of up to NEAR_LENGTH, within two edits.
WORD_LENGTH, NEAR_LENGTH = 11, 13
#: Longer tokens share a folder of the vocabulary.
LONG = 64
KEY = ("series_id", "book_number", "chapter_number", "level", "chunk_index")


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def single_spaces(text: Column) -> Column:
    """For each token of a text, in order, whether one plain space stands before it."""
    gaps = F.regexp_extract_all(text, F.lit(r"(?U)(\s+)"))
    inner = F.when(text.rlike(r"(?U)^\s"), F.slice(gaps, 2, F.size(gaps))).otherwise(gaps)
    return F.concat(F.array(F.lit(False)), F.transform(inner, lambda g: g == " "))


def grouped(tokens: Column, spaced: Column | None = None) -> Column:
    """array<struct<token, positions, spaced>>: each distinct token of an array with its places,
    ascending, and those of them that an array of flags names."""

    def runs(pairs: Column, starts: Column) -> Column:
        size = lambda i, k: F.coalesce(F.try_element_at(starts, k + 2), F.size(pairs) + 1) - i
        places = lambda i, k: F.transform(F.slice(pairs, i, size(i, k)), lambda x: x["p"])
        named = lambda i, k: F.transform(F.filter(F.slice(pairs, i, size(i, k)), lambda x: x["s"]), lambda x: x["p"])
        return F.transform(starts, lambda i, k: F.struct(F.element_at(pairs, i)["t"].alias("token"), places(i, k).alias("positions"), named(i, k).alias("spaced")))

    def split(pairs: Column) -> Column:
        begins = lambda i: (i == 1) | (F.element_at(pairs, i)["t"] != F.element_at(pairs, F.greatest(i - 1, F.lit(1)))["t"])
        return _let(F.struct(pairs.alias("a"), F.filter(F.sequence(F.lit(1), F.size(pairs)), begins).alias("s")), lambda x: runs(x["a"], x["s"]))

    flags = F.transform(tokens, lambda _: F.lit(False)) if spaced is None else F.slice(spaced, 1, F.size(tokens))
    pairs = F.zip_with(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("p"))), flags, lambda x, f: F.struct(x["t"].alias("t"), x["p"].alias("p"), f.alias("s")))
    none = F.array().cast("array<struct<token: string, positions: array<int>, spaced: array<int>>>")
    return F.when(F.size(tokens) > 0, _let(F.array_sort(pairs), split)).otherwise(none)


SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _alone(text: str, size: int) -> list[bool]:
    """single_spaces() of one text for its first ``size`` tokens."""
    gaps = SPACE.findall(text)
    if text and SPACE.match(text[0]):
        gaps = gaps[1:]
    return [False, *(g == " " for g in gaps)][:size]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What grouped() gives, of the rows of a batch at once: a row for each distinct token of each chunk."""
    for batch in batches:
        lists = batch.column("tokens")
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        place = (np.arange(len(flat)) - first[row]).astype(np.int32)
        spaced = np.concatenate([np.array(_alone(t, n), bool) for t, n in zip(batch.column("text").to_pylist(), size.tolist(), strict=True)])
        code = flat.indices.to_numpy()
        key = row * len(flat.dictionary) + code
        order = np.argsort(key, kind="stable")  # places stay ascending
        start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        own = row[order][start]
        named = spaced[order]
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        positions = pa.ListArray.from_arrays(ends(np.diff(np.append(start, len(order)))), pa.array(place[order]))
        after = pa.ListArray.from_arrays(ends(np.add.reduceat(named, start, dtype=np.int64)), pa.array(place[order][named]))
        words = flat.dictionary.take(pa.array(code[order][start]))
        yield pa.RecordBatch.from_arrays([words, pa.array(size[own].astype(np.int32)), positions, after, *(batch.column(c).take(pa.array(own)) for c in PLACE)], names=["token", "size", "positions", "spaced", *PLACE])


def postings(chunks: DataFrame) -> DataFrame:
    """A row for each distinct token of each chunk; chunks need ``text``, ``tokens`` and the columns of PLACE."""
    rows = chunks.select(*PLACE, "tokens", "text").mapInArrow(_grouped, POSTINGS.removesuffix(", bucket int"))
    return rows.withColumn("bucket", bucket(F.col("token")))


@contextmanager
def _small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans planned inside give a task SPLIT bytes at most, so that what it makes of them is sorted in memory."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_postings(chunks: DataFrame, path: str) -> None:
    """No exchange: each task sorts the postings of its part of the stored chunks into files of the buckets."""
    with _small_splits(chunks.sparkSession):
        postings(chunks).sortWithinPartitions("bucket", "token", "book_number", "chapter_number").write.partitionBy("bucket").parquet(path)


def edits(length: int) -> int:
    """The most edits that a token of a length may be from a word it resembles."""
    return max(longer // 5 for longer in range(length, 2 * length + 5) if longer - length <= longer // 5)


def segments(length: int) -> list[tuple[int, int]]:
    """(place, size) of the segments of a token of a length: one more than the edits it may be off, two at most."""
    n = min(2, edits(length)) + 1
    cuts = [length * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _variant(length: Column, i: Column, segment: Column) -> Column:
    return F.xxhash64(length, i, segment)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """Hashes of the segments of tokens of up to NEAR_LENGTH characters."""
    short = vocabulary.filter(F.col("length").between(1, NEAR_LENGTH))
    of = lambda n: F.array(*[F.struct(F.lit(i).alias("i"), F.substring("token", a + 1, size).alias("s")) for i, (a, size) in enumerate(segments(n))])
    cut = reduce(lambda out, n: out.when(F.col("length") == n, of(n)), range(2, NEAR_LENGTH + 1), F.when(F.col("length") == 1, of(1)))
    parts = short.select("token", "length", F.explode(cut).alias("p"))
    return parts.select(_variant(F.col("length"), F.col("p.i"), F.col("p.s")).alias("variant"), "token").withColumn("bucket", F.pmod("variant", F.lit(BUCKETS)).cast("int"))


def _probes(word: str) -> list[tuple[int, int, str]]:
    """(length, segment, text): every part of a word that may be a segment of a token that resembles it."""
    out = set()
    for length in range(1, NEAR_LENGTH + 1):
        k = max(length, len(word)) // 5
        if abs(length - len(word)) <= k:
            out |= {(length, i, word[at : at + size]) for i, (a, size) in enumerate(segments(length)) for at in range(max(0, a - k), min(a + k, len(word) - size) + 1)}
    return sorted(out)


def write_vocabulary(postings_: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Tokens that ``known`` lacks and their segments, in folders ``vocabulary`` and ``neighbours``."""
    tokens = postings_.select("token").distinct()
    if known is not None:
        tokens = tokens.join(known.select("token"), "token", "left_anti")
    tokens.withColumn("length", F.least(F.length("token"), F.lit(LONG))).repartition("length", F.pmod(F.xxhash64("token"), F.lit(PARTS))).sortWithinPartitions("length", "token").write.partitionBy("length").parquet(f"{path}/vocabulary")
    fresh = postings_.sparkSession.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")
    neighbours(fresh).repartition("bucket").sortWithinPartitions("bucket", "variant").write.partitionBy("bucket").parquet(f"{path}/neighbours")


class Index:
    """Postings, vocabulary and neighbours of a chunk table, as stored."""

    def __init__(self, postings_: DataFrame, vocabulary: DataFrame, neighbours_: DataFrame):
        self.postings, self.vocabulary, self.neighbours = postings_, vocabulary, neighbours_

    def of(self, words: list[str]) -> DataFrame:
        """Postings of words: folders of their buckets, row groups of the words."""
        return self.postings.filter(F.col("bucket").isin([bucket(F.lit(w)) for w in words]) & F.col("token").isin(words))

    def alike(self, word: str) -> DataFrame:
        """(word, token): the tokens within a fifth of the longer length of a word."""
        longer = F.greatest(F.length("token"), F.lit(len(word)))
        near = (F.abs(F.length("token") - len(word)) * 5 <= longer) & (F.levenshtein("token", F.lit(word)) * 5 <= longer)
        if len(word) <= WORD_LENGTH:
            probes = [_variant(*map(F.lit, p)) for p in _probes(word)]  # under 100
            folders = [F.pmod(v, F.lit(BUCKETS)).cast("int") for v in probes]
            found = self.neighbours.filter(F.col("bucket").isin(folders) & F.col("variant").isin(probes)).select("token").distinct()
        else:
            lengths = sorted({min(n, LONG) for n in range(len(word) // 2, 2 * len(word) + 1) if abs(n - len(word)) * 5 <= max(n, len(word))})
            found = self.vocabulary.filter(F.col("length").isin(lengths)).select("token")
        return found.filter(near).select(F.lit(word).alias("word"), "token")


Guard = Callable[[DataFrame], DataFrame]


def _shown(found: DataFrame, kind: str, threshold: float, matched: Column) -> DataFrame:
    kept = found.filter(F.col("score") > threshold)
    return kept.select(chunk_key(*map(F.col, KEY)).alias("chunk_key"), *PLACE, "score", F.lit(kind).alias("match_type"), matched.alias("matched"))


def exact(index: Index, query: str, threshold: float = THRESHOLD, guard: Guard | None = None) -> DataFrame:
    """Share of the distinct keywords that are tokens of a chunk."""
    words = keywords(query)
    hits = index.of(words)
    held = (guard(hits) if guard else hits).groupBy(*PLACE).agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # at most the words
    return _shown(held.withColumn("score", F.size("tokens") / F.lit(float(max(1, len(words))))), "exact", threshold, F.col("tokens"))


def all_keywords(index: Index, words: list[str], guard: Guard | None = None) -> DataFrame:
    """Chunks that hold every keyword."""
    wanted = sorted({w.lower() for w in words})
    return exact(index, " ".join(wanted), 1 - 0.5 / max(1, len(wanted)), guard)


def proximity(index: Index, query: str, threshold: float = THRESHOLD, window: int = WINDOW, guard: Guard | None = None) -> DataFrame:
    """Largest share of the keywords, repeated ones counted each time, in ``window`` tokens in a row."""
    count = Counter(query.lower().split())
    if not count:
        return exact(index, query, threshold, guard)
    hits = index.of(sorted(count)).filter(F.col("size") >= window)
    places = (guard(hits) if guard else hits).select(*PLACE, F.col("size").alias("__n"), F.explode("positions").alias("p"), F.col("token").alias("t"))
    return _shown(near_words(places, list(PLACE), count, window), "proximity", threshold, F.array().cast("array<string>"))


def fuzzy(index: Index, query: str, threshold: float = THRESHOLD, guard: Guard | None = None) -> DataFrame:
    """Share of the keywords that resemble a token of a chunk."""
    words = keywords(query)
    if not words:
        return exact(index, query, threshold, guard)
    alike = reduce(DataFrame.unionByName, [index.alike(w) for w in words]).withColumn("bucket", bucket(F.col("token")))
    hits = guard(index.postings) if guard else index.postings
    held = hits.drop("positions", "spaced", "size").join(alike, ["bucket", "token"]).groupBy(*PLACE).agg(F.sort_array(F.collect_set("word")).alias("words"))
    return _shown(held.withColumn("score", F.size("words") / F.lit(float(len(words)))), "fuzzy", threshold, F.col("words"))


def _containing(index: Index, phrase_: str, guard: Guard | None) -> DataFrame:
    """PLACE of chunks that contain a phrase of words one space apart.

    Its first word ends a token, its last one begins a token, and those between are tokens, all
    in a row with one space before each but the first: so the vocabulary and places decide,
    and no text is read.
    """
    words = phrase_.split(" ")
    fits = [F.col("token").contains(phrase_)] if len(words) == 1 else [F.col("token").endswith(words[0]), *(F.col("token") == w for w in words[1:-1]), F.col("token").startswith(words[-1])]
    least = [F.col("length") >= min(len(w), LONG) for w in words]
    wanted = reduce(DataFrame.unionByName, [index.vocabulary.filter(n & fit).select("token", F.lit(i).alias("__i")) for i, (n, fit) in enumerate(zip(least, fits, strict=True))])
    hits = guard(index.postings) if guard else index.postings
    held = hits.join(wanted.withColumn("bucket", bucket(F.col("token"))), ["bucket", "token"])
    if len(words) == 1:
        return held.select(*PLACE).distinct()
    at = held.select(*PLACE, "__i", F.explode(F.when(F.col("__i") == 0, F.col("positions")).otherwise(F.col("spaced"))).alias("__p"))
    rows = at.groupBy(*PLACE, (F.col("__p") - F.col("__i")).alias("__at")).agg(F.count_distinct("__i").alias("__n"))
    return rows.filter(F.col("__n") == len(words)).select(*PLACE).distinct()


def phrase(index: Index, query: str, threshold: float = THRESHOLD, guard: Guard | None = None, strict: bool = False) -> DataFrame:
    """Share of the phrases that a chunk contains, for phrases of words one space apart.

    Others need the texts: an empty phrase is in every text, and other white space isn't
    indexed. search.phrase() scans for those.
    """
    wanted = phrases(query, strict)
    if not wanted:
        return exact(index, "", threshold, guard)
    if not indexed(wanted):
        raise ValueError(f"a scan is needed for {wanted}")
    found = reduce(DataFrame.unionByName, [_containing(index, p, guard).withColumn("__w", F.lit(i)) for i, p in enumerate(wanted)])
    listed = F.array(*map(F.lit, wanted))
    held = found.groupBy(*PLACE).agg(F.transform(F.sort_array(F.collect_set("__w")), lambda i: F.element_at(listed, i + 1)).alias("hit"))
    return _shown(held.withColumn("score", F.size("hit") / F.lit(float(len(wanted)))), "phrase", threshold, F.col("hit"))


def indexed(wanted: list[str]) -> bool:
    """Whether places alone decide on all phrases."""
    return all(p and " ".join(p.split()) == p and not any(ord(c) < 32 for c in p) for p in wanted)


STRATEGIES = {Strategy.EXACT: exact, Strategy.PHRASE: phrase, Strategy.PROXIMITY: proximity, Strategy.FUZZY: fuzzy}


def search(index: Index, query: str, strategy: Strategy | str = Strategy.EXACT, threshold: float = THRESHOLD, max_results: int = MAX_RESULTS, guard: Guard | None = None) -> DataFrame:
    """The best chunks (place, score, what matched; no text) by a strategy, or by fuzzy matching where that finds none."""
    strategy = Strategy(strategy)
    primary = best_first(STRATEGIES[strategy](index, query, threshold, guard=guard), max_results)
    if strategy is Strategy.FUZZY or not query.strip():
        return primary
    found = primary.collect()
    if found:
        return primary.sparkSession.createDataFrame(found, primary.schema).coalesce(1)
    return best_first(fuzzy(index, query, threshold, guard), max_results)


def texts(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of a search with their texts. They are few, so their books and chapters go to the scan as literals."""
    place = list(KEY)
    at = found.select("book_number", "chapter_number").distinct().collect()
    books, chapters = (sorted({r[c] for r in at if r[c] is not None}) for c in ("book_number", "chapter_number"))
    near = chunks.filter(F.col("book_number").isin(books) & F.col("chapter_number").isin(chapters))
    return near.select(*place, "text").join(F.broadcast(found), place)
