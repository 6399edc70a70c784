import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleweft.llm import sharding


def test_query_law(spark, data):
    rows = sharding.op1_sharding(spark, data).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts) == len({r["doc_id"] for r in rows})
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "rows", None)


def test_layout_does_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    key = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(sharding.shard(docs, 5)) == key(sharding.shard(docs.repartition(7), 5))


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("score", "shard").withColumnRenamed("lang", "slot")
    rows = sharding.shard(clash, 3, blocks=4).collect()
    assert Counter(r["shard"] for r in rows) == {0: 3, 1: 3, 2: 2}
    assert len([r for r in rows if r["doc_id"] == 1]) == 2
    assert sharding.shard(no_docs, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd_docs, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 9))
def test_matrix_sums(counts, shards, seed):
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    m = sharding.communication_matrix(counts, room, seed)
    assert [sum(r) for r in m] == counts
    assert [sum(r[s] for r in m) for s in range(shards)] == room


def test_draws_have_the_right_distribution():
    rng = random.Random(4)
    got = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(40_000))
    from math import comb

    for k in range(6):
        assert got[k] / 40_000 == pytest.approx(comb(6, k) * comb(9, 5 - k) / comb(15, 5), abs=0.01)


def test_main_path_has_no_python(spark, data):
    plan = sharding.op1_sharding(spark, data)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_equal_rows_are_placed_independently(spark):
    twice = spark.range(1000).selectExpr("id", "'x' AS text").crossJoin(spark.range(2).select()).repartition(3)
    rows = sorted((r["shard"], r["slot"], r["id"]) for r in sharding.shard(twice, 4, blocks=16).collect())
    assert len(rows) == 2000 and set(Counter(i for *_, i in rows).values()) == {2}
    beside = sum(a[0] == b[0] and a[2] == b[2] for a, b in zip(rows, rows[1:]))
    assert beside <= 8  # about one by chance
    together = sum(n == 2 for n in Counter((s, i) for s, _, i in rows).values())
    assert 190 <= together <= 310  # a quarter by chance


def test_one_row_may_be_most_of_the_table(spark):
    hot = spark.range(4000).selectExpr("if(id < 3000, 0, id) AS id").repartition(5)
    rows = sharding.shard(hot, 4, blocks=8, max_block_rows=400).collect()
    n = Counter(r["shard"] for r in rows)
    assert set(n.values()) == {1000} and len({(r["shard"], r["slot"]) for r in rows}) == 4000
    per = Counter(r["shard"] for r in rows if r["id"] == 0)
    assert all(690 <= x <= 810 for x in per.values())
    halves = Counter(r["slot"] < 500 for r in rows if r["id"] == 0)
    assert abs(halves[True] - halves[False]) < 200
