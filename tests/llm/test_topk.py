import math

import numpy as np
from pyspark.sql import types as T

from taleweft.llm import topk

from ..oracle import assert_same, connect

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.LongType()))])


def brute(rows, queries, k):
    best, out = {}, []
    for i, v in rows:
        if i is not None and v is not None and None not in v:
            best[i] = min(v, best.get(i, v))
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(best[q], v, strict=True)), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_equals_its_sql(spark, data):
    assert_same(topk.op3_topk(spark, data), connect(data), topk.OP3_SQL)


def test_ties_copies_nulls_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(300)]
    rows += [(1000 + i, [1, 2, 3, 0]) for i in range(50)] + [(2000, [1, 2]), (2001, [3, 1]), (3000, None), (3001, [1, None, 2, 3]), (None, [1, 1, 1, 1]), (5, rows[5][1]), (6, [3, 3, 3, 3]), (6, [-9, 9, 9, 9]), (7, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": topk.F.lit("x"), "floor": topk.F.lit(1), "v": topk.F.lit(None)})
    queries = [0, 5, 6, 50, 1000, 1049, 2000]
    got = topk.top_k(df, df.filter(topk.F.col("vec_id").isin(queries)), 5, shard_rows=24, block_rows=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [2**40 + i, 3 - i]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    small = [(i, [1000 + i, 2**20 * (i % 3)]) for i in range(20)]
    tiny = spark.createDataFrame(small, SCHEMA)
    assert sorted(map(tuple, topk.top_k(tiny, tiny.filter("vec_id < 4"), 3).collect())) == brute(small, range(4), 3)
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_bounds_prune_but_never_lose():
    rng = np.random.default_rng(1)
    x = rng.integers(-256, 256, (2000, 8)).astype(float) + 400 * (np.arange(2000)[:, None] % 5 - 2)
    q = x[:20]
    tree = topk.BallTree(x)
    got = topk.search(tree, x[tree.order], [np.array([i]) for i in range(2000)], q, np.arange(20), np.full(20, -np.inf), 5)
    want = brute(list(enumerate(x.astype(int).tolist())), range(20), 5)
    assert sorted((i, v, s) for i, v, s in got) == sorted((i, v, s) for i, _, v, s in want)


def test_clustered_vectors_leave_most_cells_unvisited(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (30, 8))
    x = centres[np.arange(3000) % 30] + rng.integers(-40, 41, (3000, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = list(range(0, 3000, 50))
    sent: list[int] = []
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, pairs=sent)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 5)
    cells = math.ceil(math.sqrt(len(rows)))
    assert sent[0] == len(queries) and sum(sent) < len(queries) * cells / 4


def test_hot_cells_and_blocks_of_queries_change_nothing(spark):
    """A third of all rows is one vector; shards and blocks are cut small."""
    rng = np.random.default_rng(6)
    rows = [(i, [9, -9, 9]) if i % 3 == 0 else (i, rng.integers(-20, 21, 3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.filter("vec_id % 7 = 0"), 5, shard_rows=16, block_rows=4, cells=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(0, 400, 7), 5)


def test_query_leaves_out_components_that_are_not_finite(spark, tmp_path):
    rows = [(i, [float(i % 11) - 5, 0.5, -0.25]) for i in range(120)] + [(150, [None, 1.0, 1.0]), (200, [float("nan"), 1.0, 1.0]), (250, [float("inf"), 1.0, 1.0]), (300, None), (350, [2.0, 2.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i < 120 or i == 350]
    assert sorted(map(tuple, topk.op3_topk(spark, str(tmp_path)).collect())) == brute(kept, [0, 50, 100, 350], 5)
