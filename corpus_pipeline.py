"""The training-data pipeline over ``documents``: five stages that each apply one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next stage's docs. All but the last return the columns of ``documents``. In every stage
a null text counts as empty, repeated rows are rows like others until the near-duplicate
stage, columns beside those of ``documents`` pass through, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweft.llm import decontaminate, mixing, neardup, quality, sharding
from taleweft.llm.common import stored

#: Documents that score less are rejected.
QUALITY = 0.3
SHARDS = 8


def _free(name: str, docs: DataFrame) -> str:
    """The name, or a longer one where ``docs`` has such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: those that score QUALITY or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = _free("__score", docs)
    scored = quality.classify(docs, quality.train(docs, labels), score=score)
    return scored.filter(F.col(score) >= QUALITY).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id; rows without an id all stay."""
    return neardup.deduplicate(docs, counts=True)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never; a null source is one of its own."""
    words, copies, target, whole = (_free(x, docs) for x in ("__words", "__copies", "__target", "__source_size"))
    mixed = mixing.mix(docs.withColumn(words, mixing.word_count(F.col("text"))), size=words, copies=copies, target=target, source_size=whole)
    taken = mixed.filter(F.col(copies) > 0)
    return taken.withColumn(words, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def share_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in one of the shards, with its slot there; equal rows are placed independently."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("sharding", share_out),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
