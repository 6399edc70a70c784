"""What is kept beside ``embeddings``, up to date with its files: the pruned vector table, and the closure of the label hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import closure
from ..operators.pivots import VectorTable, write_vectors
from ..sources.workspace import work_dir
from . import tables
from .shelf import files, mark_of

#: So many generations lie side by side before all is written anew.
GENERATIONS = 16
_kept: dict[tuple[str, str], tuple[tuple, list[tuple], VectorTable]] = {}
_closures: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def label_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor pairs of the label hierarchy as of now: new edges extend it; where edges went, it's made anew."""
    mark = mark_of(files(spark, f"{sf_dir}/embeddings.parquet"))
    place = (spark.sparkContext.applicationId, sf_dir)
    if place in _closures and _closures[place][0] == mark:
        return _closures[place][1]
    edges = tables.label_tree(spark, sf_dir)[1].select("parent_key", "child_key")
    known = _closures[place][1] if place in _closures else None
    if known is not None:
        held = known.filter("depth = 1").select(F.col("ancestor_key").alias("parent_key"), F.col("descendant_key").alias("child_key"))
        ends = ["parent_key", "child_key"]
        gone = not held.join(edges, ends, "left_anti").isEmpty()
        edges, known = (edges, None) if gone else (edges.join(held, ends, "left_anti"), known)
    pairs = closure(edges, known)
    _closures[place] = (mark, pairs)
    return pairs


def vector_table(spark: SparkSession, sf_dir: str) -> VectorTable:
    """The table as of now: new files are a further generation; where files changed or went, all is made anew."""
    source = f"{sf_dir}/embeddings.parquet"
    listed = files(spark, source)
    mark = mark_of(listed)
    place = (spark.sparkContext.applicationId, sf_dir)
    if place in _kept and _kept[place][0] == mark:
        return _kept[place][2]
    names = [(r["path"], r["length"], r["at"]) for r in listed.select("path", "length", F.unix_micros("modificationTime").alias("at")).collect()]
    read: DataFrame = spark.read.parquet(source)
    old = _kept.get(place)
    if old and old[2].generations < GENERATIONS and set(old[1]) < set(names) and old[2].pivots:
        table = old[2]
        table.append(spark.read.schema(read.schema).parquet(*[n[0] for n in names if n not in set(old[1])]))
    else:
        table = write_vectors(read, f"{work_dir(spark)}/vectors")
    _kept[place] = (mark, names, table)
    return table
