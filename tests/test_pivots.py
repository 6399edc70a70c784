import math
import random

import pytest
from pyspark.sql import functions as F

from taleweft.operators import pivots
from taleweft.operators.vector import similar
from taleweft.plans import vector_shelf


@pytest.fixture(scope="module")
def clustered(spark):
    """Eight far clusters, ties, copies, and vectors that have no distance."""
    rng = random.Random(2)
    rows = [(i, [100.0 * (i % 8) + rng.gauss(0, 1), 50.0 * (i % 3) + rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(20)] + [(3000, None), (3001, [1.0, 2.0]), (3002, [math.nan, 0.0, 0.0]), (3003, [0.0, 0.0, 0.0]), (3004, [None, 1.0, 1.0]), (3005, [math.inf, 0.0, 0.0]), (3006, [])]
    return spark.createDataFrame(rows, "chunk_key long, embedding array<double>").withColumns({"cell_name": F.lit("x"), "lang": F.when(F.col("chunk_key") % 10 == 0, "de")})


def shown(df):
    return [(r["chunk_key"], round(r["distance"], 9) if not math.isnan(r["distance"]) else None) for r in df.select("chunk_key", "distance").collect()]


def files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


@pytest.mark.parametrize("metric", ["squared_l2", "cosine"])
def test_results_equal_the_scan(spark, clustered, tmp_path, metric):
    table = pivots.write_vectors(clustered, str(tmp_path / "v"), metric, pivots=8)
    assert table.rows().count() == clustered.filter("embedding IS NOT NULL").count()
    for q in ([105.0, 2.0, 0.0], [700.0, 100.0, 3.0], [0.0, 0.0, 0.0], [1e6, -1e6, 0.0], [350.0, 75.0, 1.0], [1.0, 2.0]):
        for k in (1, 25):
            assert shown(pivots.nearest(table, q, k)) == shown(similar(clustered, q, k, metric)), (q, k)
        german = lambda rows: rows.filter("lang = 'de'")
        assert shown(pivots.nearest(table, q, 10, german)) == shown(similar(german(clustered), q, 10, metric))
    assert shown(pivots.nearest(table, [105.0, 2.0, 0.0], 5000)) == shown(similar(clustered, [105.0, 2.0, 0.0], 5000, metric))
    assert sorted(pivots.nearest(table, [1.0, 1.0, 1.0]).columns) == sorted([*clustered.columns, "distance"])


def test_plan_prunes_folders_and_pushes_ranges(spark, clustered, tmp_path):
    table = pivots.write_vectors(clustered, str(tmp_path / "v"), pivots=8)
    q = [105.0, 2.0, 0.0]
    worst = similar(clustered, q, 10).agg(F.max("distance")).first()[0]
    rows = pivots.within(table, q, math.sqrt(worst))
    assert rows.count() < table.rows().count() / 8
    assert files_read(rows) < files_read(table.rows()) / 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(__d0" in plan.split("PushedFilters: [")[1]


def test_appended_vectors_are_seen_and_an_empty_table_is_empty(spark, clustered, tmp_path):
    table = pivots.write_vectors(clustered.filter("chunk_key < 600"), str(tmp_path / "v"), pivots=4)
    table.append(clustered.filter("chunk_key >= 600"))
    q = [705.0, 2.0, 0.0]
    assert table.generations == 2 and shown(pivots.nearest(table, q, 25)) == shown(similar(clustered, q, 25))
    none = pivots.write_vectors(clustered.filter("false"), str(tmp_path / "e"))
    assert pivots.nearest(none, q).count() == 0
    assert pivots.nearest(pivots.write_vectors(clustered.filter("chunk_key = 3001"), str(tmp_path / "o")), q).count() == 0


def test_the_kept_table_follows_its_files(spark, tmp_path):
    write = lambda ids, mode: spark.createDataFrame([(i, [float(i), 1.0], 0) for i in ids], "vec_id long, embedding array<float>, label int").coalesce(1).write.mode(mode).parquet(f"{tmp_path}/embeddings.parquet")
    ids = lambda: [r["vec_id"] for r in pivots.nearest(vector_shelf.vector_table(spark, str(tmp_path)), [9.0, 1.0], 3, key="vec_id").collect()]
    write([1, 2, 3, 4], "append")
    assert ids() == [4, 3, 2]
    first = vector_shelf.vector_table(spark, str(tmp_path))
    write([9, 30], "append")
    assert ids() == [9, 4, 3] and vector_shelf.vector_table(spark, str(tmp_path)) is first
    write([5, 6], "overwrite")
    assert ids() == [6, 5]


def test_copies_of_one_vector_spread_over_tasks(spark, tmp_path):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = pivots.write_vectors(spark.createDataFrame(rows, "chunk_key long, embedding array<double>"), str(tmp_path / "v"), pivots=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = table.rows().filter("embedding[1] = 2").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 1500
    assert [r[0] for r in shown(pivots.nearest(table, [1.0, 2.0], 4))] == [1, 2, 4, 5]
