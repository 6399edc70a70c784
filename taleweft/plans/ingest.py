"""From book files to a chunk store with its hierarchy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, cluster, hierarchy
from ..providers import hashed_embedding, keep_text
from ..sources import readers, writers


@dataclass
class Ingested:
    chunks: DataFrame
    edges: DataFrame | None


def chunk_books(books: DataFrame, series_id: int, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Level-1 chunks with keys and positions of (book_filename, book_number, text)."""
    return chunking.chapter_chunks(chunking.chapters(chunking.lines(books)), series_id, size, overlap)


def semantic_chunks(sentences: DataFrame, per: list[str], order: str, share: float = 0.95, least: int = 3) -> DataFrame:
    """(per..., segment, text, embedding) of sentence rows (text, embedding): cut where neighbours differ most, small ones joined."""
    cut = chunking.segments(sentences, per, order, share)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text", F.col("embedding").cast("array<double>").alias("embedding"))))
    grouped = cut.groupBy(*per, "segment").agg(ordered.alias("s"))
    mean = F.aggregate("s", F.transform(F.element_at("s", 1)["embedding"], lambda x: F.lit(0.0)), lambda a, s: F.zip_with(a, s["embedding"], lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / F.size("s")))
    return chunking.merge_small(grouped.select(*per, "segment", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), mean.alias("embedding")), per, least)


def ingest(spark: SparkSession, paths: str | list[str], series_id: int, embed=None, summarise=keep_text, max_levels: int = 3, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, **params) -> Ingested:
    """Chunks of all levels of the books at ``paths``, and their edges; further parameters go to the clustering."""
    embed = embed or hashed_embedding()
    first = chunk_books(readers.read_books(spark, paths), series_id, size, overlap).withColumn("embedding", embed(F.col("text")))
    everything, edges = cluster.levels(first, summarise, embed, max_levels, **params)
    names = first.select("book_number", "book_filename").distinct()
    chunks = everything.join(names, "book_number")
    return Ingested(hierarchy.with_edges(chunks, edges) if edges is not None else chunks, edges)


def store(ingested: Ingested, series_id: int, path: str) -> None:
    """Normalise, check and append what the store at ``path`` hasn't got."""
    spark = ingested.chunks.sparkSession
    rows = writers.check_complete(writers.normalised(ingested.chunks, series_id))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    existing = spark.read.parquet(path) if there else rows.filter(F.lit(False))
    writers.append_new(rows, existing, path)
