"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Equal rows are numbered: they're combined to one row and a count before the shuffle and
   dealt out again with their numbers, so a row of any frequency spreads. Rows fall into
   logical blocks by a hash of the row and its number, and the blocks are counted.
2. The driver draws how many rows of each block go to each shard, exactly as a uniform
   permutation would deal them: row by row of the matrix, a multivariate hypergeometric
   draw from the room that is left in the shards. The matrix holds blocks x shards
   numbers, whatever the rows.
3. Each block is permuted locally and dealt by the matrix; the rows are exchanged.
4. Each shard is permuted again, in sub-blocks, so that no task holds a whole shard.

Blocks come from the data, not from Spark's partitions, so reruns, lost executors and
other layouts of the input give the same shards. All row work is DataFrame functions.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_hash, without

#: The matrix and the table of sub-blocks are held to so many numbers.
MAX_CELLS = 1 << 22


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many good ones are among ``n`` drawn without replacement; exact inversion from the mode."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_p = (
        lg(good + 1) - lg(mode + 1) - lg(good - mode + 1)
        + lg(bad + 1) - lg(n - mode + 1) - lg(bad - n + mode + 1)
        - lg(good + bad + 1) + lg(n + 1) + lg(good + bad - n + 1)
    )
    p_mode = math.exp(log_p)
    u = rng.random()
    up, p_up, down, p_down = mode, p_mode, mode, p_mode
    u -= p_mode
    while u > 0:
        moved = False
        if up < hi:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            moved = True
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            moved = True
            u -= p_down
            if u <= 0:
                return down
        if not moved or p_up + p_down == 0:
            return mode
    return mode


def communication_matrix(counts: list[int], room: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``counts``, columns to ``room``."""
    rng, left, matrix = random.Random(seed), list(room), []
    for n in counts:
        row, rest = [], sum(left)
        for s, cap in enumerate(left):
            rest -= cap
            x = hypergeometric(rng, cap, rest, n) if n else 0
            row.append(x)
            n -= x
            left[s] -= x
        matrix.append(row)
    return matrix


def _small(spark: SparkSession, rows: list[tuple[int, int, list[int]]]) -> DataFrame:
    """A driver-side table of at most MAX_CELLS numbers as a literal, to be broadcast."""
    text = json.dumps([{"a": a, "b": b, "c": c} for a, b, c in rows])
    parsed = F.from_json(F.lit(text), "array<struct<a: int, b: int, c: array<bigint>>>")
    return spark.range(1).select(F.inline(parsed).alias("__a", "__b", "__c"))


def _halves(key: Column, salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")


def shard(df: DataFrame, shards: int = 8, seed: int = 17, blocks: int = 4096, max_block_rows: int = 1 << 18, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows of ``df`` with ``shard_col`` (int) and ``slot_col`` (long, gapless from 0 in its shard).

    Counts of shards differ by one at most; earlier shards take the surplus. Input columns of
    the result's names are replaced. Any column may be null; wholly equal rows are all kept
    and placed independently of each other; an empty table gives an empty result; fewer rows
    than shards leave shards empty. Blocks are made finer while one holds over ``max_block_rows``.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    kept = without(df, shard_col, slot_col)
    alike = kept.select(F.struct("*").alias("__row"), row_hash(kept, seed).alias("__h1"), row_hash(kept, seed + 1).alias("__h2")).groupBy("__h1", "__h2").agg(F.first("__row").alias("__row"), F.count("*").alias("__count"))
    keyed = alike.withColumn("__k", F.explode(F.sequence(F.lit(1), "__count"))).select("__row", F.xxhash64("__h1", "__h2", "__k").alias("__key"))
    most = max(1, MAX_CELLS // shards)
    blocks = min(blocks, most)
    while True:
        counted = {r[0]: r[1] for r in keyed.groupBy(_halves(F.col("__key"), 1, blocks).alias("b")).count().collect()}
        if max(counted.values(), default=0) <= max_block_rows or blocks * 8 > most:
            break
        blocks *= 8
    total = sum(counted.values())
    order = sorted(counted)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counted[b] for b in order], room, seed)
    bounds = []
    for b, row in zip(order, matrix, strict=True):
        reach, ends = 0, []
        for x in row:
            reach += x
            ends.append(reach)
        bounds.append((b, 0, ends))

    local = Window.partitionBy("__block").orderBy(F.xxhash64("__key", F.lit(2)), "__key")
    subs = max(1, min(blocks // shards, MAX_CELLS // shards))

    def dealt(rows: DataFrame) -> DataFrame:
        with_block = rows.withColumn("__block", _halves(F.col("__key"), 1, blocks))
        ends = F.broadcast(_small(spark, bounds).select(F.col("__a").alias("__block"), F.col("__c").alias("__ends")))
        ranked = with_block.withColumn("__n", F.row_number().over(local).cast("long"))
        placed = ranked.join(ends, "__block").withColumn("__shard", F.size(F.filter("__ends", lambda e: e < F.col("__n"))))
        return placed.withColumn("__sub", _halves(F.col("__key"), 3, subs)).drop("__ends", "__n", "__block")

    held = {(r[0], r[1]): r[2] for r in dealt(keyed.select("__key")).groupBy("__shard", "__sub").count().collect()}
    starts: list[tuple[int, int, list[int]]] = []
    for s in range(shards):
        reach = 0
        for b in range(subs):
            if (s, b) in held:
                starts.append((s, b, [reach]))
                reach += held[s, b]
    again = Window.partitionBy("__shard", "__sub").orderBy(F.xxhash64("__key", F.lit(4)), "__key")
    first = F.broadcast(_small(spark, starts).select(F.col("__a").alias("__shard"), F.col("__b").alias("__sub"), F.element_at("__c", 1).alias("__start")))
    out = dealt(keyed).withColumn("__n", F.row_number().over(again)).join(first, ["__shard", "__sub"])
    return out.select("__row.*", F.col("__shard").cast("int").alias(shard_col), (F.col("__start") + F.col("__n") - 1).alias(slot_col))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``; a null text counts as empty, repeated rows and empty tables as in shard()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(digest, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
