import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweft.operators import cluster

ROWS = "g string, id long, x array<double>"


@pytest.fixture(scope="module")
def blobs(spark):
    """Two groups: one of three clear clusters, one of two; and one of too few rows."""
    rng = np.random.default_rng(2)
    rows = [("a", i, (rng.normal(size=4) + [[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 0, 0]][i % 3]).tolist()) for i in range(150)]
    rows += [("b", i, (rng.normal(size=4) + 8 * (i % 2)).tolist()) for i in range(60)] + [("c", i, [float(i), 0.0, 0.0, 0.0]) for i in range(4)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def fitted(blobs):
    return cluster.fit(blobs, 3, most=4, part_rows=40)


def test_likelihood_never_falls_and_inertia_never_rises(fitted):
    past = {}
    for made in fitted.models[1:]:
        for r in made.collect():
            likelihood, inertia = past.get((r["g"], r["k"]), (-np.inf, np.inf))
            assert r["likelihood"] >= likelihood - 1e-6 * abs(likelihood) if np.isfinite(likelihood) else True
            assert r["inertia"] <= inertia + 1e-6
            past[r["g"], r["k"]] = r["likelihood"], r["inertia"]
    assert set(past) == {(g, k) for g in "ab" for k in range(1, 5)}


def test_scores_equal_a_recomputation_from_densities(fitted):
    """Likelihood, inertia and BIC of the models, worked out again from weights, means and covariances of the rows."""
    z = {}
    for r in fitted.rows.collect():
        z.setdefault(r["g"], []).append(r["z"])
    models = {(r["g"], r["k"]): np.array(r["used"]) for r in fitted.models[-1].collect()}
    for r in cluster.scores(fitted, 3).collect():
        x, k = np.array(z[r["g"]]), r["k"]
        m = cluster._split(models[r["g"], k], k, 3)
        density = np.zeros(len(x))
        for j in range(k):
            cov = np.linalg.inv(m.factors[j].T @ m.factors[j])
            y = x - m.means[j]
            density += np.exp(m.weights[j]) * np.exp(-0.5 * np.einsum("ni,ij,nj->n", y, np.linalg.inv(cov), y)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov))
        likelihood = np.log(density).sum()
        assert r["likelihood"] == pytest.approx(likelihood, rel=1e-6) and r["n"] == len(x)
        assert r["bic"] == pytest.approx(((k - 1) + 3 * k + 6 * k) * np.log(len(x)) - 2 * likelihood, rel=1e-6)
        assert r["inertia"] == pytest.approx(sum(min(((p - c) ** 2).sum() for c in m.centres) for p in x), rel=1e-6)


def test_best_count_is_the_greater_of_elbow_and_criterion(spark):
    rows = [("a", 1, 100.0, 9.0), ("a", 2, 90.0, 1.0), ("a", 3, 20.0, 5.0), ("a", 4, 19.0, 6.0), ("b", 1, 5.0, 1.0), ("c", 1, 9.0, 5.0), ("c", 2, 1.0, 4.0), ("c", 3, 0.5, 1.0)]
    got = {r["g"]: r["k"] for r in cluster.best_count(spark.createDataFrame(rows, "g string, k int, inertia double, bic double")).collect()}
    assert got == {"a": 2, "b": 1, "c": 3}


def test_two_phases_in_parts_of_a_group(spark, blobs):
    """Clusters lie inside the true ones, in whatever parts a group is dealt; small groups are one; odd rows are kept out."""
    odd = blobs.selectExpr("g AS book", "CASE WHEN g = 'c' THEN NULL ELSE 1 END AS chapter", "id AS k", "x AS embedding", "1 AS cluster", "2 AS g")
    odd = odd.unionByName(spark.createDataFrame([("a", 1, 999, None, 1, 2)], odd.schema))
    out = cluster.cluster(odd.drop("cluster", "g"), ["book", "chapter"], "k", dim=3, most=4, part_rows=40).collect()
    assert len(out) == 214
    label = {(r["book"], r["k"]): r["cluster"] for r in out}
    assert {label["c", i] for i in range(4)} == {0}
    for book, n, true in (("a", 150, 3), ("b", 60, 2)):
        of = [{label[book, i] for i in range(n) if i % true == t} - {None} for t in range(true)]
        assert all(of) and not any(of[i] & of[j] for i in range(true) for j in range(i))
        assert sum(label[book, i] is None for i in range(n)) < n / 10


def test_no_group_is_gathered(fitted, blobs):
    plan = cluster.fit(blobs, 3, most=2, rounds=0).models[0]
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    assert fitted.rows.groupBy("g", "part").count().agg(F.max("count")).first()[0] < 60


def test_no_rows(spark):
    none = spark.createDataFrame([], "b int, chunk_key string, embedding array<float>")
    assert cluster.cluster(none, ["b"]).count() == 0
