"""Ranked lexical search by windowed bucket scoring over an inverted index.

The index numbers documents densely: a window is a fixed range of numbers (``WINDOW`` at
most), small enough that an array of scores stays in the cache, and a posting names a
document by its place in its window. A search traverses the postings of its terms window by
window: each term's scores are scatter-added into the array, an occupancy bitset tells which
documents were touched, and those are harvested into a heap of the best of each item, which
lives on from window to window. What leaves a task is one heap an item.

A document is a row, so repeated ids are documents of their own. Which documents share a
window depends on the layout of the input, but no score does. Items are taken in blocks of
``BLOCK_TERMS`` terms, which go out with the tasks; each block reads the index again, not the
texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored

WINDOW = 4096
#: A window of long texts is closed at so many bytes.
WINDOW_BYTES = 1 << 24
BLOCK_TERMS = 1 << 20
BEST = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "window bigint, term binary, docs array<int>, counts array<int>, ids array<bigint>"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 0


def terms_of(text: Column) -> Column:
    """Terms of a text in order, with repeats; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})")), F.array().cast("array<string>"))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def invert(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; distinct terms, how many texts hold each, and those texts with the counts."""
    raw = FOLD[np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)]
    # A text ends at a \0 of its own; those inside a text are separators like others.
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    inside = np.concatenate([[False], raw != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    doc = np.searchsorted(ends, first, "right")
    held = np.bincount(doc, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 0].tobytes())]).dictionary_encode()
    key, counts = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + doc, return_counts=True)
    term, doc = np.divmod(key, len(texts))
    return held, words.dictionary, np.bincount(term, minlength=len(words.dictionary)), doc.astype(np.int32), counts.astype(np.int32)


def _invert(window: int, window_bytes: int) -> Callable:
    schema = pa.schema([("window", pa.int64()), ("term", pa.binary()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])

    def closed(number: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        held, terms, sizes, docs, counts = invert(texts)
        if len(terms):
            head = [pa.array([number]), pa.array([None], pa.binary()), pa.array([None], schema.types[2]), pa.array([held.tolist()], schema.types[3]), pa.array([ids], schema.types[4])]
            yield pa.RecordBatch.from_arrays(head, schema=schema)
            rows = [pa.array(np.full(len(terms), number)), terms, _lists(docs, sizes), _lists(counts, sizes), pa.nulls(len(terms), schema.types[4])]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    if texts and (len(texts) >= window or size + len(text) > window_bytes):
                        yield from closed(number, ids, texts)
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
        if texts:
            yield from closed(number, ids, texts)

    return run


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """The stored index of all rows of ``docs``.

    For each window a row without a term holds the ids and sizes of its documents, and one for
    each term the places of the documents that hold it, with how often. Ids are long or null;
    a null or empty text has no terms.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(given.mapInArrow(_invert(window, window_bytes), INDEX))


@dataclass
class Query:
    """Items of a block by number: the places of their terms in ``terms``; ``weights`` is parallel to that."""

    numbers: list[int]
    places: list[np.ndarray]
    weights: dict[bytes, tuple[int, int]]  # term -> place, weight


def _harvest(heap: list, scores: np.ndarray, touched: np.ndarray, ids: np.ndarray, unknown: np.ndarray, best: int) -> None:
    """Push the documents touched that may be among the best; equal scores by smaller id, null last."""
    at = np.flatnonzero(np.unpackbits(touched, count=len(scores)))
    at = at[scores[at] >= max(1, heap[0][0] if len(heap) == best else 1)]
    if len(at) > best:
        at = at[np.lexsort((ids[at], unknown[at], -scores[at]))[:best]]
    for score, gone, doc in zip(scores[at].tolist(), unknown[at].tolist(), ids[at].tolist(), strict=True):
        entry = (score, not gone, -doc)
        if len(heap) < best:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _score(shared, total: int, length: int, best: int) -> Callable:
    schema = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: Query = shared.value
        heaps: list[list] = [[] for _ in query.numbers]
        window, ids, unknown, weight_of = None, None, None, None
        gains: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def close() -> None:
            scores = np.zeros(len(ids), np.int64)
            for places, heap in zip(query.places, heaps, strict=True):
                here = [gains[p] for p in places.tolist() if p in gains]
                if not here:
                    continue
                scores[:] = 0
                touched = np.zeros((len(ids) + 7) // 8, np.uint8)
                for docs, gain, bits in here:
                    scores[docs] += gain  # a document is in a term's postings once
                    touched |= bits
                _harvest(heap, scores, touched, ids, unknown, best)

        for batch in batches:
            for row in range(batch.num_rows):
                number, term = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if number != window:
                    if window is not None:
                        close()
                    window, gains = number, {}
                counts = batch.column(3)[row].values.to_numpy()
                if term is None:  # sorted first in its window
                    given = batch.column(4)[row].values
                    unknown = given.is_null().to_numpy(zero_copy_only=False)
                    ids = given.fill_null(0).to_numpy()
                    weight_of = np.array([50 + 50 * n * total // length for n in counts.tolist()], np.int64)
                    continue
                place, weight = query.weights[term]
                docs, tf = batch.column(2)[row].values.to_numpy(), counts.astype(np.int64)
                flags = np.zeros(len(ids), bool)
                flags[docs] = True
                gains[place] = docs, weight * (1_000_000_000 * tf // (1000 * tf + 20 * weight_of[docs])), np.packbits(flags)
        if window is not None:
            close()
        found = [(number, None if not known else -doc, score) for number, heap in zip(query.numbers, heaps, strict=True) for score, known, doc in heap]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """For each row of ``items`` its ``best`` documents: item_id, rank (int from 1), doc_id, score.

    Only scores above 0 count; equal scores go by ascending id, null last. Item rows that are
    equal each get their own ranking; one without a term gets none. An empty index or no items
    give no rows.
    """
    spark = index.sparkSession
    numbered = stored(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), F.array_distinct(terms_of(F.col(text))).alias("terms")))
    size, n_items = numbered.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    total, length = index.filter("term IS NULL").agg(
        F.coalesce(F.sum(F.size(F.filter("counts", lambda n: n > 0))), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))
    ).first()
    out = None
    if size and length:
        blocks = -(-size // block_terms)
        for b in range(blocks):
            found = _search_block(spark, index, numbered.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b), total, length, best)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= best)
    return ranked.join(numbered.drop("terms"), "number").select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, items: DataFrame, total: int, length: int, best: int) -> DataFrame:
    terms = items.select(F.explode("terms").alias("t")).select(F.col("t").cast("binary").alias("term")).distinct()
    hits = index.filter("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi")  # bounded by the block
    holding = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    ratio = F.lit(2.0 * total + 2) / (2 * F.col("df") + 1).cast("double")
    weights = holding.select("term", F.floor(F.lit(1000.0) * F.log(ratio)).alias("w")).collect()  # a row a term of the block
    place = {bytes(r["term"]): (i, r["w"]) for i, r in enumerate(weights)}
    numbers, places = [], []
    for r in items.select("number", "terms").collect():
        mine = [place[t][0] for t in map(str.encode, r["terms"]) if t in place]
        if mine:
            numbers.append(r["number"])
            places.append(np.array(mine, np.int64))
    shared = spark.sparkContext.broadcast(Query(numbers, places, place))
    lists = index.filter("term IS NULL").unionByName(hits.select(*index.columns))
    ordered = lists.repartition("window").sortWithinPartitions("window", F.col("term").asc_nulls_first())
    return ordered.mapInArrow(_score(shared, total, length, best), "number bigint, doc_id bigint, score bigint")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 of all documents for each benchmark item."""
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
OP13_SQL = f"""WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
size AS (SELECT d, doc_id, len(terms)::BIGINT AS n FROM doc WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM size),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM doc) GROUP BY ALL),
item AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
asked AS (SELECT i, unnest(terms) AS term FROM item),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
norm AS (SELECT d, doc_id, 50 + ((50 * n * docs) // length) AS m FROM size, whole),
score AS (SELECT i, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN norm USING (d) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 50"""
