"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass over the corpus counts in how many documents each n-gram of the benchmark is.
2. Of every ``window`` consecutive n-grams of an item the rarest becomes a seed, so any
   ``window + n - 1`` words of an item that a document holds unchanged contain a seed.
3. A second pass finds seeds in documents; each seed gives the place where the item would
   lie, and the words there are aligned with the item's words. The score is the alignment's
   share of a full match.

The benchmark goes to the executors in blocks of at most ``block_words`` words, so what is
broadcast has a bound; a larger benchmark takes more passes. Documents are never shuffled
and no window of a document is left out.

Items of fewer than ``exact_below`` words, which alignment can't tell from chance, match as
a whole word sequence; those shorter than a seed are seeds themselves, of their own length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of
from .textkit import Words, grams, words

BITS = 20


@dataclass
class Lookup:
    """Sorted 64-bit keys behind a bitmap that turns most others away."""

    keys: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Lookup:
        keys = np.unique(keys)
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[(keys & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        return cls(keys, bitmap)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, numbers of their keys)."""
        at = np.flatnonzero(self.bitmap[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


@dataclass
class Block:
    """Some items of the benchmark: their words and the n-grams at each place."""

    ids: list[int]
    words: list[np.ndarray]
    lookup: Lookup
    places: dict[int, list[tuple[int, int]]]  # number of a key: (item, place)
    sizes: list[int]  # words of its seeds: n, and those of shorter items
    exact_below: int


def align(item: np.ndarray, region: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int]:
    """Best local score and where it ends in the region (the first such place)."""
    h = np.zeros(len(region) + 1, np.int64)
    slope = gap * np.arange(len(region) + 1)
    best, end = 0, 0
    for w in item:
        new = np.empty_like(h)
        new[0] = 0
        new[1:] = np.maximum(np.maximum(h[:-1] + np.where(region == w, match, -miss), h[1:] - gap), 0)
        h = np.maximum.accumulate(new + slope) - slope
        top = int(h.argmax())
        if h[top] > best:
            best, end = int(h[top]), top
    return best, end


def begin(item: np.ndarray, region: np.ndarray, end: int) -> int:
    """Where the best alignment that ends at ``end`` starts: the latest such place, found backwards."""
    return end - align(item[::-1], region[:end][::-1])[1]


def compare(w: Words, i: int, g: np.ndarray, at: np.ndarray, block: Block, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end in words) of items that text ``i`` holds; g and at: its n-grams and places."""
    own = w[i]
    hits, keys = block.lookup.find(g)
    lines: dict[int, list[int]] = defaultdict(list)
    for p, k in zip(at[hits].tolist(), keys.tolist(), strict=True):
        for item, q in block.places.get(k, ()):
            lines[item].append(p - q)
    found = []
    for item, starts in lines.items():
        target = block.words[item]
        starts = sorted(set(starts))
        if len(target) < block.exact_below:
            x = next((x for x in starts if 0 <= x <= len(own) - len(target) and (own[x : x + len(target)] == target).all()), None)
            if x is not None:
                found.append((item, 1.0, x, x + len(target)))
            continue
        slack = max(4, len(target) // 3)
        best, a = (0, 0, 0), starts[0]
        for x, nxt in zip(starts, [*starts[1:], None], strict=True):
            if nxt is None or nxt - x > len(target) + 2 * slack:
                lo, hi = max(0, a - slack), min(len(own), x + len(target) + slack)
                score, end = align(target, own[lo:hi])
                if score > best[0]:
                    best = (score, lo, lo + end)
                a = nxt
        share = best[0] / (2 * len(target))
        if share >= threshold:
            _, lo, end = best
            found.append((item, share, lo + begin(target, own[lo:end], end - lo), end))
    return found


def _blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items come to the driver one partition at a time, and leave it in blocks."""
    ids, held, size = [], [], 0
    for row in items.toLocalIterator():
        h = words([row[1] or ""]).h
        if row[0] is None or not len(h):
            continue
        ids.append(row[0])
        held.append(h)
        size += len(h)
        if size >= block_words:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def _all_grams(w: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the n-grams of several sizes, in order of place."""
    found = [grams(w, n) for n in sizes]
    if len(found) == 1:
        return found[0]
    g, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return g[order], at[order]


def _gram_list(held: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The n-grams of each item; the whole of an item that is shorter."""
    out = []
    for h in held:
        out.append(grams(Words(h, np.zeros(len(h), np.int64), np.array([0, len(h)])), min(n, len(h)))[0])
    return out


def _counting(lookup: Lookup, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(lookup.keys), np.int64)
        for part in slices(batches, "__text"):
            w = words(texts_of(part, "__text"))
            g, at = _all_grams(w, sizes)
            hit, k = lookup.find(g)
            if len(hit):
                pairs = np.unique(w.text[at[hit]] * len(df) + k)
                df += np.bincount(pairs % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["k", "df"])

    return run


def _seeds(per_item: list[np.ndarray], lookup: Lookup, df: np.ndarray, window: int) -> dict[int, list[tuple[int, int]]]:
    """The rarest n-gram of each window, at all its places in the items."""
    numbers = [np.searchsorted(lookup.keys, g) for g in per_item]
    chosen = set()
    for k in numbers:
        for i in range(max(1, len(k) - window + 1)):
            part = k[i : i + window]
            chosen.add(int(part[np.lexsort((part, df[part]))[0]]))
    places = defaultdict(list)
    for item, k in enumerate(numbers):
        for q, x in enumerate(k.tolist()):
            if x in chosen:
                places[x].append((item, q))
    return dict(places)


def _prepared(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, n: int, window: int, exact_below: int, block_words: int) -> Iterator[Block]:
    for ids, held in _blocks(items.select(item_id, item_text), block_words):
        per_item = _gram_list(held, n)
        sizes = sorted({min(n, len(h)) for h in held})
        lookup = Lookup.of(np.concatenate(per_item))
        counted = docs.select(F.col(text).alias("__text")).mapInArrow(_counting(lookup, sizes), "k long, df long").groupBy("k").agg(F.sum("df").alias("df"))
        df = np.zeros(len(lookup.keys), np.int64)
        for row in counted.collect():  # a row per n-gram of the block at most
            df[row["k"]] = row["df"]
        places = _seeds(per_item, lookup, df, window)
        used = lookup.keys[np.array(sorted(places), np.int64)]
        yield Block(ids, held, Lookup.of(used), {j: places[k] for j, k in enumerate(sorted(places))}, sizes, exact_below)


def _matching(block, threshold: float, text: str):
    """Each row of a batch with what it holds."""

    def run(part: pa.RecordBatch) -> list[list[tuple[int, float, int, int]]]:
        b = block.value
        w = words(texts_of(part, text))
        g, at = _all_grams(w, b.sizes)
        cut = np.searchsorted(at, w.first)
        return [compare(w, i, g[cut[i] : cut[i + 1]], at[cut[i] : cut[i + 1]] - w.first[i], b, threshold) for i in range(part.num_rows)]

    return run


DEFAULTS = {"n": 3, "window": 3, "exact_below": 8, "block_words": 1 << 20}


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, **params) -> DataFrame:
    """A row for each document and item that it holds: ``doc_id``, ``item_id``, ``score``
    (0 to 1), ``start`` and ``end`` (the aligned place, in words).

    Null texts are empty; a null document id is kept in the row; items with a null id or
    without words match nothing; items of fewer than ``exact_below`` words match whole and
    unchanged. Repeated documents and items each give rows; of equally good places the first
    counts. Ids may be of any type; other columns take no part. Empty tables give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    params = DEFAULTS | params
    spark, found = docs.sparkSession, []
    item_type = to_arrow_type(items.schema[item_id].dataType)
    kinds = (docs.schema[doc_id].dataType, items.schema[item_id].dataType, T.DoubleType(), T.LongType(), T.LongType())
    schema = T.StructType([T.StructField(c, k) for c, k in zip(("doc_id", "item_id", "score", "start", "end"), kinds, strict=True)])
    narrow = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    for block in _prepared(docs, text, items, item_id, item_text, **params):
        sent = spark.sparkContext.broadcast(block)
        match = _matching(sent, threshold, "__text")

        def run(batches: Iterator[pa.RecordBatch], match=match, sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "__text"):
                got = [(i, *x) for i, row in enumerate(match(part)) for x in row]
                ids = part.column("__id").take(pa.array([x[0] for x in got], pa.int64()))
                items_ = [sent.value.ids[x[1]] for x in got]
                yield pa.RecordBatch.from_arrays([ids, pa.array(items_, item_type), pa.array([x[2] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64())], names=["doc_id", "item_id", "score", "start", "end"])

        found.append(narrow.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, **params) -> DataFrame:
    """The rows of ``docs`` that hold no item; as hits() for nulls, short items and empty tables."""
    params = DEFAULTS | params
    spark = docs.sparkSession
    kept = docs
    for block in _prepared(docs, text, items, item_id, item_text, **params):
        match = _matching(spark.sparkContext.broadcast(block), threshold, text)

        def run(batches: Iterator[pa.RecordBatch], match=match) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                yield part.filter(pa.array([not x for x in match(part)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, and where; nulls, short items, ties and empty tables as in hits()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
