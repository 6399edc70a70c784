"""Exact vector top-k that reads only what the triangle inequality can't rule out.

Vectors are stored in folders by their nearest pivot, sorted by their distance to it, with
the distances to all pivots as columns. By the triangle inequality a vector within ``r`` of a
query lies, for every pivot, within ``r`` of the query's own distance to that pivot. Once k
rows of the nearest folders give ``r``, folders out of reach are pruned, and the rest are
ranges over the columns, which Parquet checks by row group. Results equal
:func:`.vector.similar`.

A vector that has no distance to the pivots (another length, a null or NaN component, for the
cosine a length of 0) can't be ruled out: it lies in folder -1, which is always read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import squared_l2
from .vector import NORMAL, similar

PIVOTS = 16
#: Pivots are chosen among so many vectors, those of the least hashes.
SAMPLE = 4096
#: Distances are trusted to this share, which widens every bound.
SLACK = 1e-9


@dataclass
class Cell:
    """A folder of one generation: its rows, and the range of their distances to its pivot."""

    generation: int
    number: int
    rows: int
    nearest: float | None
    farthest: float | None


@dataclass
class VectorTable:
    """A stored table of vectors. ``pivots`` and ``cells`` are small: at most 17 cells a generation."""

    spark: SparkSession
    root: str
    schema: str
    metric: str
    embedding: str
    pivots: list[list[float]]
    cells: list[Cell] = field(default_factory=list)
    generations: int = 0

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, generation int, cell int").parquet(self.root)

    def append(self, vectors: DataFrame) -> None:
        """Write more vectors as a further generation, by the same pivots."""
        g = self.generations
        pointed = vectors.filter(F.col(self.embedding).isNotNull())
        names = [f"__d{j}" for j in range(len(self.pivots))]
        point = _point(F.col(self.embedding), self.metric)
        far = [F.sqrt(squared_l2(point, F.array(*map(F.lit, p)))) for p in self.pivots]
        known = pointed.withColumns(dict(zip(names, far, strict=True)))
        good = F.lit(bool(names))
        for n in names:
            good = good & F.col(n).isNotNull() & ~F.isnan(n) & (F.col(n) < math.inf)
        own = F.array_min(F.array(*names)) if names else F.lit(None).cast("double")
        known = known.withColumn("__good", good).withColumn("__own", F.when(F.col("__good"), own))
        place = F.array_position(F.array(*names), F.col("__own")) - 1 if names else F.lit(-1)
        known = known.withColumn("cell", F.coalesce(place, F.lit(-1)).cast("int"))
        known = known.withColumns({n: F.when(F.col("__good"), F.col(n)) for n in names}).drop("__good")
        plain = [f"`{f.name}`" for f in vectors.schema.fields if "map<" not in f.dataType.simpleString()]
        known = known.withColumn("__tie", F.xxhash64(*plain))  # many copies of one vector spread over tasks too
        ranged = known.repartitionByRange("cell", "__own", "__tie").sortWithinPartitions("cell", "__own").drop("__tie")
        ranged.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/generation={g}")
        written = self.rows().filter(F.col("generation") == g)
        stats = written.groupBy("cell").agg(F.count("*").alias("n"), F.min("__own").alias("a"), F.max("__own").alias("b"))
        self.cells += [Cell(g, r["cell"], r["n"], r["a"], r["b"]) for r in stats.collect()]  # a row a pivot
        self.generations += 1


def _point(v: Column, metric: str) -> Column:
    """What pivots measure: the vector, or for the cosine its direction (squared, half of that distance is 1 - cos)."""
    whole = v.cast("array<double>")
    if metric == "squared_l2":
        return whole
    norm = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(whole, lambda x: x / norm))


def _choose(vectors: DataFrame, embedding: str, metric: str, pivots: int, sample: int) -> list[list[float]]:
    """Pivots far from each other, of the commonest length of the sample."""
    point = _point(F.col(embedding), metric)
    usable = vectors.select(point.alias("p")).filter("p IS NOT NULL AND size(p) > 0 AND NOT exists(p, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    some = [tuple(r["p"]) for r in usable.orderBy(F.xxhash64("p"), "p").limit(sample).collect()]
    if not some:
        return []
    lengths = [len(v) for v in some]
    usual = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([v for v in some if len(v) == usual])
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < pivots and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at].tolist()


def write_vectors(vectors: DataFrame, root: str, metric: str = "squared_l2", embedding: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE) -> VectorTable:
    """Store all rows that have a vector. Any numeric arrays do; an empty table has no pivots."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    chosen = _choose(vectors, embedding, metric, pivots, sample)
    columns = [schema, *(f"__d{j} double" for j in range(len(chosen))), "__own double"]
    table = VectorTable(vectors.sparkSession, root, ", ".join(columns), metric, embedding, chosen)
    table.append(vectors)
    return table


def _gaps(table: VectorTable, vector: list[float]) -> list[float] | None:
    """Distances from a query to the pivots; None where they bound nothing."""
    q = np.array([float(x) for x in vector])
    if not table.pivots or len(q) != len(table.pivots[0]):
        return None
    if table.metric != "squared_l2":
        norm = float(np.sqrt((q * q).sum()))
        if not norm > 0:
            return None
        q = q / norm
    gaps = np.sqrt(((np.array(table.pivots) - q) ** 2).sum(1))
    return gaps.tolist() if np.isfinite(gaps).all() else None


def _at_least(cell: Cell, gaps: list[float]) -> float:
    """No row of a cell is nearer to the query."""
    if cell.number < 0:
        return 0.0
    gap = gaps[cell.number]
    return max(0.0, gap - cell.farthest, cell.nearest - gap) - SLACK * (1 + gap)


def _of(table: VectorTable, cells: list[Cell]) -> DataFrame:
    wanted = F.lit(False)
    for g in sorted({c.generation for c in cells}):
        wanted = wanted | (F.col("generation") == g) & F.col("cell").isin([c.number for c in cells if c.generation == g])
    return table.rows().filter(wanted)


def within(table: VectorTable, vector: list[float], reach: float) -> DataFrame:
    """Rows that the pivots don't place beyond ``reach`` (a distance, for the cosine of directions)."""
    gaps = _gaps(table, vector)
    if gaps is None or reach == math.inf:
        return table.rows()
    rows = _of(table, [c for c in table.cells if _at_least(c, gaps) <= reach])
    near = F.lit(True)
    for j, gap in enumerate(gaps):
        slack = SLACK * (1 + gap + reach)
        d = F.col(f"__d{j}")
        near = near & (d.isNull() | d.between(gap - reach - slack, gap + reach + slack))  # null in folder -1 alone
    return rows.filter(near)


def nearest(table: VectorTable, vector: list[float], k: int = NORMAL, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows, key: str = "chunk_key") -> DataFrame:
    """The k stored rows nearest to a vector, as :func:`.vector.similar` gives them, of those that ``narrow`` keeps.

    ``narrow`` filters, or joins with what is guarded. The folders nearest to the query are
    read first, twice as many each time, until k rows pass; these give the reach of the search.
    """
    gaps = _gaps(table, vector)
    reach = math.inf
    if gaps is not None and k > 0:
        order = sorted(table.cells, key=lambda c: (_at_least(c, gaps), gaps[c.number] if c.number >= 0 else 0.0, c.generation, c.number))
        n = 1
        while sum(c.rows for c in order[:n]) < k and n < len(order):
            n += 1
        while n < len(order):
            first = similar(narrow(_of(table, order[:n])), vector, k, table.metric, table.embedding, key)
            found, worst = first.agg(F.count("*"), F.max("distance")).first()
            if found == k and not math.isnan(worst):
                reach = math.sqrt(max(0.0, worst) * (1 if table.metric == "squared_l2" else 2)) + SLACK
                break
            n *= 2
    rows = narrow(within(table, vector, reach))
    return similar(rows, vector, k, table.metric, table.embedding, key).drop(*(f"__d{j}" for j in range(len(table.pivots))), "__own", "cell", "generation")

