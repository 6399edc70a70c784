"""Mixing sources to target weights by cube-method balanced sampling.

Weights share out the whole size; a source takes at most ``max_repeat`` times its own, and
the excess is shared again by weight (a water-filling level, found by one pass over the
sources ordered by the level at which each one is full). A source that takes ``r`` times
its size gives ``floor(r)`` copies of every document, and one more of a balanced sample:
all documents have the inclusion probability ``r - floor(r)``, and the cube method moves
these through the null space of the constraints (number of documents, number of words)
until each is 0 or 1. The flight runs in blocks of documents, each of which leaves two
undecided at most; those meet in ever fewer blocks. In a source's last block ``LANDING``
documents of all sizes (the largest, the second, the fourth, the eighth ...) wait until the
others have flown, and what is undecided then (two more at most) is the landing problem: of all its outcomes the one nearest the source's words is taken,
then the one nearest its count. Probabilities are kept exactly for all other documents.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_hash, stored, without

EPS = 1e-9
#: Documents of a source that land, besides the two that its flight leaves.
LANDING = 10


def word_count(text) -> F.Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str, size: str, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3) -> DataFrame:
    """A row per source: ``source``, ``__n``, ``__size``, ``__target``.

    Sources in code-point order, null last, weigh ``weights`` in turn. One number per source
    is all that meets in a task.
    """
    per = sized.groupBy(F.col(source).alias("__src")).agg(F.count("*").alias("__n"), F.sum(size).alias("__size"))
    by_name = Window.orderBy(F.col("__src").asc_nulls_last())
    ranked = per.withColumn("__rank", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    full = ranked.withColumn("__w", w).withColumn("__cap", max_repeat * F.col("__size").cast("double")).withColumn("__at", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__at", "__rank")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = full.withColumn("__level", (F.sum("__size").over(whole) - before) / rest)
    first = F.min_by("__level", F.when(F.col("__at") > F.col("__level"), F.struct("__at", "__rank"))).over(whole)
    return levels.withColumn("__first", first).select(
        "__src", "__rank", "__n", F.col("__size").cast("long").alias("__size"),
        F.when(F.col("__first").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__first") * F.col("__w"))).alias("__target"),
    )


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` until two at most are strictly between 0 and 1; the sums of p and of p * size stay as they are."""
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p)).astype(float)
    open_ = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    out, sizes, draws = p.tolist(), size.astype(float).tolist(), iter(rng.random(2 * len(open_) + 8).tolist())
    active: list[int] = []
    turn = 0

    def step(at: list[int], u: list[float]) -> list[int]:
        up = min((1 - out[i]) / x if x > 0 else out[i] / -x for i, x in zip(at, u, strict=True) if x)
        down = min(out[i] / x if x > 0 else (1 - out[i]) / -x for i, x in zip(at, u, strict=True) if x)
        by = up if next(draws) * (up + down) < down else -down
        left = []
        for i, x in zip(at, u, strict=True):
            v = out[i] + by * x
            out[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            if 0 < out[i] < 1:
                left.append(i)
        return left

    while True:
        while len(active) < 3 and turn < len(open_):
            active.append(open_[turn])
            turn += 1
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            u = [b - c, c - a, a - b]
            top = max(map(abs, u))
            active = step(active, [x / top for x in u] if top else [1.0, -1.0, 0.0])
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            active = step(active, [1.0, -1.0])
        else:
            break
    return np.array(out)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each of a few ``p`` to 0 or 1: of all outcomes the one whose words are nearest, and then whose count is."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = ways - p[open_]
    words, count = np.abs(off @ size[open_].astype(float)), np.abs(off.sum(1))
    best = np.lexsort((np.arange(len(ways)), count.round(9), words.round(6)))[0]
    out = p.copy()
    out[open_] = ways[best]
    return out


def interleaved(size: np.ndarray) -> np.ndarray:
    """An order of large and small in turn: the small ones balance each large one while it is open."""
    down = np.argsort(-size, kind="stable")
    half = (len(down) + 1) // 2
    order = np.empty_like(down)
    order[::2], order[1::2] = down[:half], down[half:][::-1]
    return order


def _fly(seed: int, level: int, land: bool):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        pdf = pdf.sort_values("__key")
        pdf = pdf.iloc[interleaved(pdf["__unit"].to_numpy())]
        p, unit = pdf["__p"].to_numpy(), pdf["__unit"].to_numpy()
        wait = np.argsort(unit, kind="stable")[[len(p) - (1 << k) for k in range(LANDING if land else 0) if 1 << k <= len(p)]]
        flown = np.setdiff1d(np.arange(len(p)), wait)
        out = p.copy()
        out[flown] = flight(p[flown], unit[flown], rng)
        return pdf.assign(__p=landing(out, unit) if land else out)

    return run


def mix(df: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3, seed: int = 29, block_rows: int = 1024, copies: str = "copies", target: str = "target", source_size: str = "source_size") -> DataFrame:
    """All rows of ``df`` with their copies in the mix (int), their source's target and size.

    ``size`` is a column of whole numbers; null or negative counts as 0, and a document of
    size 0 takes part in the count alone. A null source is one of its own. Of wholly
    equal rows each gets the whole part of its rate, and as many of them one more as the rest
    asks for, give or take one; which of them is no difference. A source without words takes nothing.
    An empty table gives an empty result. Equal input gives an equal result, in any layout.
    """
    kept = without(df, copies, target, source_size)
    keyed = kept.select(F.struct("*").alias("__row"), row_hash(kept, seed).alias("__key"), row_hash(kept, seed + 1).alias("__key2"), F.col(source).alias("__src"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__sz"))
    per = stored(targets(keyed, "__src", "__sz", weights, max_repeat))
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    base = F.floor(rate + EPS)
    # Of n equal rows floor(n p) are taken once more and one is left to chance, so they're one unit of a row's size.
    units = keyed.groupBy("__src", F.xxhash64("__key", "__key2").alias("__key"), F.col("__sz").alias("__unit")).agg(F.count("*").alias("__many"))
    joined = units.alias("u").join(per.alias("s"), F.col("u.__src").eqNullSafe(F.col("s.__src")))
    step = joined.select("__rank", "__key", "__unit", F.ceil(F.col("__n") / block_rows).alias("__blocks"), base.alias("__base"), (F.col("__many") * F.greatest(rate - base, F.lit(0.0))).alias("__q"))
    step = step.select("__rank", "__key", "__unit", "__blocks", "__base", F.floor(F.col("__q") + EPS).alias("__sure"), F.greatest(F.col("__q") - F.floor(F.col("__q") + EPS), F.lit(0.0)).alias("__p"))
    schema = "__rank int, __key long, __unit long, __blocks long, __base long, __sure long, __p double"
    most = per.agg(F.max("__n")).first()[0] or 0
    blocks, level, done = -(-most // block_rows), 0, []
    while True:
        last = blocks <= 1
        block = F.pmod(F.xxhash64("__key", F.lit(seed + level)), F.greatest(F.col("__blocks"), F.lit(1)))
        moved = stored(step.groupBy("__rank", block.alias("__block")).applyInPandas(_fly(seed, level, last), schema))
        settled = (F.col("__p") <= 0) | (F.col("__p") >= 1)
        done.append(moved.filter(settled))
        if last:
            break
        step = moved.filter(~settled).withColumn("__blocks", F.ceil(2 * F.col("__blocks") / block_rows))
        blocks, level = -(-2 * blocks // block_rows), level + 1
    chosen = reduce(DataFrame.unionByName, done).select(F.col("__key").alias("__k"), "__rank", F.col("__base").cast("int").alias("__base"), (F.col("__sure") + F.col("__p").cast("long")).alias("__more"))
    with_target = chosen.join(F.broadcast(per) if most and per.count() <= 10_000 else per, "__rank")
    alike = keyed.groupBy(F.xxhash64("__key", "__key2").alias("__key"), "__key2").agg(F.first("__row").alias("__row"), F.count("*").alias("__many"))
    joined = alike.join(with_target.select("__k", "__base", "__more", "__target", "__size"), F.col("__key") == F.col("__k"))
    out = joined.withColumn("__i", F.explode(F.sequence(F.lit(1), "__many"))).withColumn("__copies", F.col("__base") + (F.col("__i") <= F.col("__more")).cast("int"))
    return out.select("__row.*", F.col("__copies").alias(copies), F.col("__target").alias(target), F.col("__size").alias(source_size))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from them; nulls, repeated rows and empty tables as in mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
