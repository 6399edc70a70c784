"""Exact top-k inner products by ball-tree branch and bound in shards.

1. Vectors go to the cell of their nearest pivot, a pivot being a vector of a bounded sample;
   a cell is cut into shards of bounded size. The table of cells (pivot and radius, 4,097 rows
   at most) bounds what a query can score in each: ``q . pivot + |q| * radius``.
2. A query visits the cell of its highest bound first, then the next 8, 64, 512 ... in waves.
   The kth score that it has reached is shared with the next wave, and only pairs of a query
   and a cell whose bound reaches that score are shuffled; a query without any is done.
3. A task grows the ball tree of a shard and streams a block of queries past it; in the tree
   nodes are visited by the same bound, down to the kth score. Shards that many queries visit
   are searched by several tasks, each with a block of them and a tree of its own.

Equal vectors are one point of a tree with its smallest ids; k + 1 of them are all that any
result can hold, ties going to the smaller id and a query's own row being left out. Vectors
without structure in many dimensions leave bounds nothing to cut: then all pairs of query and
cell are searched, which is exact but no faster than a scan.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAF = 64
HITS = "qid long, vec_id long, score long"
#: Pivots at most, and so the vectors that the driver sees.
CELLS = 4096
#: Cells that a query visits in each wave, by its bounds; the last wave takes the rest.
WAVES = (1, 8, 64, 512)


class Cells:
    """Pivots by vector length. Cell -1 holds vectors of lengths without a pivot, about the origin."""

    def __init__(self, sample: list[list[float]]):
        self.pivots: dict[int, tuple[int, np.ndarray]] = {}  # length -> (number of the first, pivots)
        self.radii: dict[int, float] = {}  # of the cells that hold vectors
        first = 0
        for dim in sorted({len(v) for v in sample if len(v)}):
            own = np.unique(np.array([v for v in sample if len(v) == dim]), axis=0)
            self.pivots[dim] = first, own
            first += len(own)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its centre of vectors of one length."""
        if x.shape[1] not in self.pivots:
            return np.full(len(x), -1), np.sqrt((x**2).sum(1))
        first, own = self.pivots[x.shape[1]]
        near = ((own**2).sum(1) - 2 * (x @ own.T)).argmin(1)
        return near + first, np.sqrt(((x - own[near]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cells that hold vectors of this length, and what each query can score there at most."""
        norms = np.sqrt((q**2).sum(1))[:, None]
        first, own = self.pivots.get(q.shape[1], (0, np.empty((0, q.shape[1]))))
        held = [i for i in range(len(own)) if first + i in self.radii]
        numbers, centres, radii = [first + i for i in held], own[held], [self.radii[first + i] for i in held]
        if q.shape[1] and -1 in self.radii:
            numbers, centres, radii = [*numbers, -1], np.concatenate([centres, np.zeros((1, q.shape[1]))]), [*radii, self.radii[-1]]
        radii = np.array(radii)
        return np.array(numbers, np.int32), q @ centres.T + norms * radii + _slack(norms, np.sqrt((centres**2).sum(1)) + radii)


def _slack(norms: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What rounding can take from a bound."""
    return 1e-6 * (1 + norms) + 1e-12 * norms * reach


class BallTree:
    """Nodes in arrays; children of node i are ``left[i]`` and ``right[i]``, leaves hold rows ``a:b``."""

    def __init__(self, x: np.ndarray):
        self.order, self.scored = np.arange(len(x)), 0
        self.a, self.b, self.left, self.right = [], [], [], []
        centres, radii = [], []
        todo = [(0, len(x), None, None)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.a)
            if parent is not None:
                (self.left if side == 0 else self.right)[parent] = me
            own = x[self.order[a:b]]
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            self.a.append(a), self.b.append(b), self.left.append(-1), self.right.append(-1)
            centres.append(centre), radii.append(far.max())
            if b - a <= LEAF or far.max() == 0:
                continue
            one = own[far.argmax()]
            d1 = ((own - one) ** 2).sum(1)
            two = own[d1.argmax()]
            lean = own @ (two - one)
            half = (b - a) // 2
            part = np.argpartition(lean, half)
            self.order[a:b] = self.order[a:b][part]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floats while they hold every integer met, else 64-bit integers."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if top < 2.0**52:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def search(tree: BallTree, ranked: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(number of the query, vec_id, score): the k best of each query that reach its floor; ``ranked`` are the points in the tree's order."""
    out = []
    norms = np.sqrt((queries**2).sum(1))
    bounds = queries @ tree.centres.T + norms[:, None] * tree.radii + _slack(norms[:, None], np.sqrt((tree.centres**2).sum(1)) + tree.radii)
    for i, q in enumerate(queries):
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its head is the kth
        heap = [(-bounds[i, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            least = max(floor[i], best[0][0] if len(best) == k else -math.inf)
            if -bound < least:
                break
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if bounds[i, child] >= least:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            a, b = tree.a[node], tree.b[node]
            s = _scores(ranked[a:b], q)
            tree.scored += b - a
            for j in np.flatnonzero(s >= least).tolist():
                for v in ids[tree.order[a + j]].tolist():
                    if v == own[i]:
                        continue
                    item = (int(s[j]), -v)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        break  # ids ascend
        out += [(i, -v, s) for s, v in best]
    return out


class Shard:
    """The trees of a shard, one for each length of its vectors."""

    def __init__(self, parts: list[tuple[np.ndarray, list[np.ndarray]]], k: int):
        self.k, self.trees = k, {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for own, vectors in parts:
            for i, v in zip(own.tolist(), vectors, strict=True):
                by_length.setdefault(len(v), []).append((i, v))
        for dim, rows in by_length.items():
            if dim:
                x, own = np.stack([v for _, v in rows]), np.array([i for i, _ in rows], np.int64)
                order = np.lexsort((own, *x.T[::-1]))
                x, own = x[order], own[order]
                new = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]).any(1)) + 1, [len(x)]])
                points = x[new[:-1]]
                tree = BallTree(points)
                self.trees[dim] = tree, points[tree.order], [own[a : min(b, a + k + 1)] for a, b in zip(new[:-1], new[1:], strict=True)]

    def answers(self, own: np.ndarray, vectors: list[np.ndarray], floor: np.ndarray) -> Iterator[tuple[int, int, int]]:
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths).tolist():
            if dim in self.trees:
                at = np.flatnonzero(lengths == dim)
                found = search(*self.trees[dim], np.stack([vectors[i] for i in at]), own[at], floor[at], self.k)
                yield from ((int(own[at[i]]), v, s) for i, v, s in found)


def _cells(k: int, step: int = 1024):
    """Rows in order of shard and block, a cell's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "block", "kind")], 1)
            for a, b in itertools.pairwise([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []):
                if cell != tuple(keys[a, :2]):
                    cell, parts, shard = tuple(keys[a, :2]), [], None
                for c in range(a, b, step):
                    part = batch.slice(c, min(step, b - c))
                    v = part.column("v")
                    cut = v.offsets.to_numpy()
                    values = v.values.to_numpy(zero_copy_only=False)
                    own, vectors = part.column("vec_id").to_numpy(), [values[x:y] for x, y in itertools.pairwise(cut.tolist())]
                    if keys[a, 2] == 0:
                        parts.append((own, [x.copy() for x in vectors]))
                        continue
                    if shard is None:
                        shard, parts = Shard(parts, k), []
                    hits = list(shard.answers(own, vectors, part.column("floor").to_numpy()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in hits], pa.int64()) for j in range(3)], names=["qid", "vec_id", "score"])

    return run


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length in a column of lists."""
    cut, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(cut)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, values[cut[at][:, None] + np.arange(dim)]


def _placed(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for at, x in _by_length(batch.column("v")):
                number[at], far[at] = cells.place(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _visits(cells: Cells, width: int | None):
    """Queries with the cells that they visit now: the best by bound that aren't done and reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, floor = batch.column("done").to_pylist(), batch.column("floor").to_numpy()
            now: list[list[int]] = [[]] * len(batch)
            for at, x in _by_length(batch.column("v")):
                for a in range(0, len(at), 256):
                    numbers, bounds = cells.bounds(x[a : a + 256])
                    for i, bound in zip(at[a : a + 256].tolist(), bounds, strict=True):
                        open_ = np.flatnonzero((bound >= floor[i]) & ~np.isin(numbers, done[i]))
                        now[i] = numbers[open_[np.argsort(-bound[open_], kind="stable")][:width]].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now, pa.list_(pa.int32()))], names=[*batch.schema.names, "now"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "vector", shard_rows: int = 8192, block_rows: int = 1 << 16, cells: int = CELLS, pairs: list[int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, ties to the smaller id.

    Both tables have ``id_col`` (long) and ``vector`` (array of whole numbers); a query meets
    vectors of its own length, and never the row of its own id. Rows with a null id, vector or
    component take no part; an id of several rows counts once, with its least vector. Fewer
    than k candidates give what there is; empty tables give no rows. Scores must fit a long.
    There are as many pivots as the root of the number of vectors, ``cells`` at most. To
    ``pairs`` the number of pairs of query and cell of each wave is appended.
    """
    spark = vectors.sparkSession
    finite = "vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))"

    def whole(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        return rows.filter(finite).groupBy("vec_id").agg(F.min("v").alias("v"))

    x, q = stored(whole(vectors)), stored(whole(queries))
    some = x.orderBy(F.xxhash64("v"), "vec_id").limit(min(cells, math.ceil(math.sqrt(x.count()))))
    cut = Cells([r["v"] for r in some.select("v").collect()])
    placed = stored(x.mapInArrow(_placed(cut), "vec_id long, v array<double>, cell int, far double"))
    parts: dict[int, int] = {}
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        parts[r["cell"]], cut.radii[r["cell"]] = math.ceil(r["n"] / shard_rows), r["far"]
    first = dict(zip(parts, itertools.accumulate(parts.values(), initial=0), strict=False))  # shards are numbered through
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = spark.createDataFrame([], HITS)
    asked = q.withColumn("done", F.array().cast("array<int>"))
    for width in itertools.chain(WAVES, itertools.repeat(None)):
        floors = found.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("floor"))
        told = asked.join(floors, F.col("vec_id") == F.col("qid"), "left").select("vec_id", "v", "done", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        sent = stored(told.mapInArrow(_visits(cut, width), "vec_id long, v array<double>, done array<int>, floor double, now array<int>").filter("size(now) > 0"))
        visits = sent.select(F.explode("now").alias("cell"), "vec_id", "v", "floor")
        asked_of = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
        if pairs is not None:
            pairs.append(sum(asked_of.values()))
        if not asked_of:
            break
        table = [(c, first[c], parts[c], math.ceil(n / block_rows)) for c, n in asked_of.items()]
        cell_table = F.broadcast(spark.createDataFrame(table, "cell int, first int, parts int, blocks int"))
        points = placed.join(cell_table, "cell").select(
            (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("floor"),
        )
        looked = visits.join(cell_table, "cell").select(
            F.explode(F.sequence(F.col("first").cast("long"), F.col("first").cast("long") + F.col("parts") - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int").alias("block"),
            F.lit(1).alias("kind"), "vec_id", "v", "floor",
        )
        hits = points.unionByName(looked).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(_cells(k), HITS)
        found = stored(ranked(found.unionByName(hits)).select("qid", "vec_id", "score"))
        if width is None:
            break
        asked = sent.select("vec_id", "v", F.concat("done", "now").alias("done"))
    return ranked(found).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every embedding whose id is divisible by 50; nulls, ties and repeated ids as in top_k()."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = table.filter("NOT exists(embedding, c -> c IS NULL OR isnan(c) OR abs(c) = float('Infinity'))")
    x = x.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(256) * c.cast("double"))).alias("vector"))
    return top_k(x, x.filter("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH x AS (
  SELECT vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding]::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM x q JOIN x ON x.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
