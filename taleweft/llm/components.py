"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _told(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) with ``m`` of their node a from ``least`` (n, m, c: its edges).

    A node of very many edges isn't shuffled to: its m goes out to all tasks. Such nodes have
    over 256 and over a 10,000th of all edges, so there are 20,000 of them at most.
    """
    many = F.col("c") > max(256, total // 10_000)
    hubs = F.broadcast(least.filter(many).select(F.col("n").alias("hub"), F.col("m").alias("far")))
    tagged = rows.join(hubs, F.col("a") == F.col("hub"), "left")
    near = tagged.filter("hub IS NULL").select("a", "b").join(least.filter(~many), F.col("a") == F.col("n")).select("a", "b", "m")
    return near.unionByName(tagged.filter("hub IS NOT NULL").select("a", "b", F.col("far").alias("m")))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count("*").alias("c")).withColumnRenamed("a", "n")
    return _told(both.filter("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Edges point from a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).withColumnRenamed("a", "n")
    moved = _told(edges, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up")))
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node with an edge; a component is named by its smallest id.

    ``edges`` has long columns a and b. Neighbours are only ever reduced to their minimum, so
    a node of any degree is combined before the shuffle, and its minimum is told by broadcast.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        total = now.count()
        now = stored(_small(stored(_large(now, total).distinct()), total).distinct())
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
