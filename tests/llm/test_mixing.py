import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleweft.llm import mixing


def water_fill(sizes, weights):
    """Share, stop at the caps, share the excess again until none is above."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > 3 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in over:
            out[i] = 3.0 * sizes[i]
        open_ -= over
    return out


def test_query_targets_and_taken(spark, data):
    rows = mixing.op6_mixing(spark, data).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r["source"] for r in docs.values()})
    total = {s: sum(size(r["text"]) for r in docs.values() if r["source"] == s) for s in sources}
    want = dict(zip(sources, water_fill([total[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))]), strict=True))
    largest = {s: max(size(r["text"]) for r in docs.values() if r["source"] == s) for s in sources}
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size(docs[r["doc_id"]]["text"]) and r["source_size"] == total[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s in sources:
        assert abs(sum(r["taken"] for r in rows if docs[r["doc_id"]]["source"] == s) - want[s]) <= largest[s]


def test_reruns_and_layouts_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", mixing.word_count(mixing.F.col("text")).alias("size"))
    key = lambda df: sorted((r["doc_id"], r["copies"]) for r in mixing.mix(df, block_rows=16).collect())
    assert key(docs) == key(docs.repartition(9))


def test_odd_rows(odd_docs, no_docs):
    sized = odd_docs.withColumn("size", mixing.word_count(mixing.F.col("text"))).withColumnRenamed("score", "copies").withColumnRenamed("lang", "target")
    rows = mixing.mix(sized).collect()
    assert len(rows) == 8
    twice = [r["copies"] for r in rows if r["doc_id"] == 1]
    assert len(twice) == 2 and max(twice) - min(twice) <= 1
    assert all(r["target"] == 0 for r in rows if r["source"] is None)
    assert mixing.mix(no_docs.withColumn("size", mixing.F.lit(1))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.floats(0.05, 0.95), st.integers(0, 5))
def test_flight_keeps_both_sums(sizes, p, seed):
    size = np.array(sizes, float)
    start = np.full(len(size), p)
    out = mixing.flight(start, size, np.random.default_rng(seed))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(start.sum(), abs=1e-6)
    assert (out * size).sum() == pytest.approx((start * size).sum(), abs=1e-4)
    landed = mixing.landing(out, size)
    assert set(landed.tolist()) <= {0.0, 1.0}


def test_flight_keeps_inclusion_probabilities():
    size = np.array([5, 1, 9, 2, 7, 3.0])
    got = np.mean([mixing.flight(np.full(6, 0.4), size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert got == pytest.approx(np.full(6, 0.4), abs=0.03)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 30)), min_size=1, max_size=7))
def test_landing_is_the_nearest_of_all_outcomes(units):
    import itertools

    p, size = np.array([x for x, _ in units]), np.array([float(s) for _, s in units])
    free = [(0.0, 1.0) if 0 < x < 1 else (x,) for x, _ in units]
    off = lambda way: abs(((np.array(way) - p) * size).sum())
    out = mixing.landing(p, size)
    assert set(out.tolist()) <= {0.0, 1.0} and off(out) <= min(map(off, itertools.product(*free))) + 1e-5


def test_documents_keep_their_probabilities_through_the_landing():
    """Over many seeds a document is taken as often as its probability says, but for those that land."""
    import pandas as pd

    rng = np.random.default_rng(1)
    unit = rng.integers(1, 400, 80)
    pdf = pd.DataFrame({"__key": np.arange(80), "__unit": unit, "__p": np.full(80, 0.3)})
    runs = [mixing._fly(seed, 0, True)((1, 0), pdf).sort_values("__key")["__p"].to_numpy() for seed in range(1500)]
    assert all(set(x.tolist()) <= {0.0, 1.0} for x in runs)
    apart = np.sort(np.abs(np.mean(runs, axis=0) - 0.3))
    assert apart[: -mixing.LANDING - 4].max() < 0.04
    words = np.array([(x * unit).sum() for x in runs])
    assert np.abs(words / (0.3 * unit.sum()) - 1).max() < 0.01


def test_every_source_comes_near_its_target(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.op6_mixing(spark, sf).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert max(abs(r["sum(taken)"] / r["max(target)"] - 1) for r in rows) < 0.02


def test_equal_rows_share_out(spark):
    """A hot row of 900 copies beside 100 others, and sources of equal rows alone, meet their targets; copies differ by one at most."""
    rows = [("a", 10, 0)] * 900 + [("a", 5 + i % 9, i) for i in range(1, 101)] + [("b", 10, -1)] * 500 + [("c", 10, -2)] * 500 + [("d", 0, 0)] * 3
    df = spark.createDataFrame(rows, "source string, size long, id long")
    mixed = mixing.mix(df.repartition(5))
    assert mixed.count() == len(rows)
    for r in mixed.groupBy("source").agg(mixing.F.sum(mixing.F.col("size") * mixing.F.col("copies")).alias("taken"), mixing.F.max("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.02), r
    hot = {r["copies"] for r in mixed.filter("id = 0 AND source = 'a'").collect()}
    assert max(hot) - min(hot) <= 1
