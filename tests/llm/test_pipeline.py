import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from taleweft.llm import decontaminate, neardup, quality


@pytest.fixture
def keep():
    """Persists what it's given for the length of a test."""
    held = []

    def persist(df):
        held.append(df.persist())
        return held[-1]

    yield persist
    for df in held:
        df.unpersist(blocking=True)


def test_stages_one_by_one(spark, data, keep):
    docs = keep(spark.read.parquet(f"{data}/documents.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing sources", "sharding"]
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    score = dict(zip(rows, model.score(quality.features(list(rows.values()))), strict=True))
    good = keep(steps["quality classifier"](spark, docs, data))
    assert good.columns == docs.columns and ids(good) == {i for i, s in score.items() if s >= corpus_pipeline.QUALITY}

    from .test_neardup import brute

    classes, _ = brute([(i, rows[i]) for i in sorted(ids(good))])
    distinct = keep(steps["near duplicates"](spark, good, data))
    assert distinct.columns == docs.columns and ids(distinct) == set(classes.values())

    items = spark.read.parquet(f"{data}/benchmark.parquet")
    held = {r["doc_id"] for r in decontaminate.hits(distinct, items).collect()}
    clean = keep(steps["benchmark decontamination"](spark, distinct, data))
    assert clean.columns == docs.columns and ids(clean) == ids(distinct) - held

    mixed = keep(steps["mixing sources"](spark, clean, data))
    assert mixed.columns == docs.columns and ids(mixed) <= ids(clean)
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(size(mixed) - size(clean)) < 0.25 * size(clean)

    shards = steps["sharding"](spark, mixed, data).collect()
    assert len(shards) == mixed.count()
    counts = [sum(r["shard"] == s for r in shards) for s in range(corpus_pipeline.SHARDS)]
    assert max(counts) - min(counts) <= 1
    assert neardup.classes(distinct).filter("id <> class_id").count() == 0


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)


def test_copies_of_the_mix_are_spread_over_shards(spark, data):
    """A document that the mix takes more than once lies anywhere: neighbours are copies as rarely as by chance."""
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    many = docs.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(docs.columns)
    rows = sorted((r["shard"], r["slot"], r["doc_id"]) for r in corpus_pipeline.share_out(spark, many, data).collect())
    assert len(rows) == 180 and sum(a[0] == b[0] and a[2] == b[2] for a, b in zip(rows, rows[1:], strict=False)) < 10
    assert max(Counter((s, i) for s, _, i in rows).values()) <= 3


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no id at all here"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    clash = odd_docs.withColumnsRenamed({"score": "__score"}).withColumns({"copies": F.lit("c"), "shard": F.lit(1), "target": F.lit(None).cast("string")})
    for docs in (odd_docs, no_docs, clash):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert len(rows) <= 3 * docs.count()
            assert name == "sharding" or out.columns == docs.columns
            if name == "sharding":
                assert len(rows) == docs.count()
            if name == "benchmark decontamination" and docs is odd_docs:
                assert len(rows) == 7  # the item of five words is a document's whole text
            if name == "near duplicates" and docs is odd_docs:
                assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 1, 2, 4, 5]
