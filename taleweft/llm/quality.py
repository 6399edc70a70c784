"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting goes round the features; each turn fits a shallow tree to the gradients in
the feature's bins and adds it to the feature's lookup table. Then the strongest pairs of
features, by the gain of one cut in both, get tables of their own in the same way. A score
is the sum of looked-up values, so all rows of a batch are scored by additions of arrays.

Features are counts over the whole text; source, language and ids play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of, without
from .textkit import ALNUM, ALPHA, DIGIT, SPACE, UPPER, grams, points, runs, words

FEATURES = ("chars", "words", "word_length", "upper", "symbols", "punctuation", "digits", "lines", "bare_symbols", "repeated", "distinct", "distinct_triples", "top_word", "sentences", "mid_upper")
PUNCTUATION = np.array([ord(c) for c in ".,;:?!'\"()-"], np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    p = points(texts)
    n = len(texts)
    chars = p.per_text(np.ones(len(p.cp), np.int64)) - 1
    flag = lambda bit: p.per_text((p.flags & bit) > 0)
    alpha, upper, digit, space = (flag(b) for b in (ALPHA, UPPER, DIGIT, SPACE))
    common = np.isin(p.cp, PUNCTUATION)
    symbol = ((p.flags & (ALNUM | SPACE)) == 0) & ~common & (p.cp != 0)
    start, end = runs(((p.flags & SPACE) == 0) & (p.cp != 0))
    reach = np.concatenate([[0], np.cumsum((p.flags & ALNUM) > 0)])
    token_text = np.searchsorted(p.starts, start, "right") - 1
    tokens = np.bincount(token_text, minlength=n)
    bare = np.bincount(token_text[reach[end] == reach[start]], minlength=n)
    mid = np.concatenate([[0], np.cumsum((p.flags & UPPER) > 0)])
    inner = np.minimum(start + 1, end)
    shout = np.bincount(token_text[mid[end] > mid[inner]], minlength=n)
    sentences = p.per_text(np.isin(p.cp, np.array([46, 33, 63], np.uint32)))
    lines = p.per_text(p.cp == 10)
    w = words(texts)
    count = np.diff(w.first)
    same = np.bincount(w.text[1:][(w.h[1:] == w.h[:-1]) & (w.text[1:] == w.text[:-1])], minlength=n) if len(w.h) else np.zeros(n)

    def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(h):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
        most = np.zeros(n)
        np.maximum.at(most, text[new], np.diff(np.concatenate([new, [len(h)]])))
        return np.bincount(text[new], minlength=n), most

    kinds, most = distinct(w.h, w.text)
    triples, at = grams(w, 3)
    n_triples = np.bincount(w.text[at], minlength=n)
    triple_kinds, _ = distinct(triples, w.text[at])
    over = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(chars), np.log1p(tokens), over(chars - space, tokens), over(upper, alpha), over(p.per_text(symbol), chars), over(p.per_text(common), chars), over(digit, chars),
        over(lines, tokens), over(bare, tokens), over(same, count), over(kinds, count), over(triple_kinds, n_triples), over(most, count), over(sentences, tokens), over(shout, tokens),
    ]).astype(float)


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # cell of each bin in the pairs' tables
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for (f, g), t in zip(self.pairs, self.grids, strict=True):
            z += t[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-z))


def _tree(grad: np.ndarray, hess: np.ndarray, splits: int, ridge: float, least: float) -> np.ndarray:
    """Values by bin of a tree of at most ``splits`` cuts, by Newton gain."""
    leaves = [(0, len(grad))]
    cg, ch = (np.concatenate([[0.0], np.cumsum(v)]) for v in (grad, hess))
    worth = lambda g, h: g * g / (h + ridge)
    for _ in range(splits):
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(leaves):
            at = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
            gain = np.where((hl >= least) & (hr >= least), worth(gl, hl) + worth(gr, hr) - worth(cg[b] - cg[a], ch[b] - ch[a]), -1.0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), i, at[gain.argmax()])
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid in both directions."""
    cg, ch = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)

    def quarters(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    g, h = quarters(cg), quarters(ch)
    gain = sum(x * x / (y + ridge) for x, y in zip(g, h, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    gain = np.where(np.min(h, axis=0) >= least, gain, -1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(grad.shape)
    for part, x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), g, h, strict=True):
        out[part] = -x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pairs: int = 8, pair_rounds: int = 40, cells: int = 8, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Model:
    """Without rows, or with one label alone, the model is a constant."""
    p = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Model(base)
    f_n = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(f_n)]
    b = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    m = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts])
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for f in range(f_n):
            g, h = slopes()
            size = len(cuts[f]) + 1
            step = rate * _tree(np.bincount(b[f], g, size), np.bincount(b[f], h, size), 2, ridge, least)
            m.tables[f] += step
            z += step[b[f]]
    m.coarse = [np.arange(len(c) + 1) * cells // (len(c) + 1) for c in cuts]
    c = [m.coarse[f][b[f]] for f in range(f_n)]
    grid = lambda f, g, v: np.bincount(c[f] * cells + c[g], v, cells * cells).reshape(cells, cells)
    g, h = slopes()
    ranked = sorted(((_cross(grid(i, j, g), grid(i, j, h), ridge, least)[0], i, j) for i in range(f_n) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    m.grids = [np.zeros((cells, cells)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(m.pairs):
            g, h = slopes()
            gain, step = _cross(grid(i, j, g), grid(i, j, h), ridge, least)
            if gain > 0:
                m.grids[k] += rate * step
                z += rate * step[c[i], c[j]]
    return m


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "__text"):
        x = features(texts_of(part, "__text"))
        yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "__y", "__x"])


def held_out(doc_id) -> F.Column:
    """Rows that never teach: crc32 of the id as text is divisible by 5 (a null id's too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_train: int = 20_000, **params) -> Model:
    """Fit on labelled documents outside the held-out fold.

    At most ``max_train`` labels are used, those of the smallest hashes of their ids; a
    document with several labels gets their mean. Null labels and ids teach nothing; of an id
    of several texts the least text teaches (null if it has no other).
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label).cast("double")).alias("__y"))
    bounded = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train))
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__text")).join(bounded, F.col("__i") == F.col("__id"))
    one = rows.groupBy("__id").agg(F.first("__y").alias("__y"), F.min("__text").alias("__text"))  # at most max_train rows
    rows = one.select("__id", "__y", "__text").mapInArrow(_measured, f"__id {known.schema['__id'].dataType.simpleString()}, __y double, __x array<double>")
    got = sorted((r["__id"], r["__x"], r["__y"]) for r in rows.collect())
    return fit(np.array([x for _, x, _ in got]).reshape(len(got), len(FEATURES)), np.array([y for *_, y in got], float), **params)


def classify(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1). Null texts count as empty; an input column named like ``score`` is replaced; no rows give no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = without(docs, score)
    out = kept.withColumn(score, F.lit(0.0))
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            values = model.score(features(texts_of(part, text)))
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip([*part.columns, pa.array(values)], schema.types, strict=True)], schema=schema)

    return kept.mapInArrow(run, out.schema)


def op4_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """The quality of every document; null texts count as empty, repeated rows are all kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = classify(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
