"""The engine's tables as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chunk_key
from ..operators.postings import Index
from .shelf import shelf

BOOK = """A word before.

CHAPTER
ONE
  «Été» came late.
It rained. Nobody minded.

Chapter 2 The Ford
- They crossed. They rested? They slept!
GLOSSARY
ford: a crossing
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-1 chunks with their positions and tokens, as stored, of all that ``documents`` holds now."""
    return shelf(spark, sf_dir).chunks()


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The inverted index of the chunk table."""
    return shelf(spark, sf_dir).index()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def label_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of three levels (vectors, their labels, labels mod 3) and the edges between them."""
    rows = vectors(spark, sf_dir).select("vec_id", "label")
    key = lambda level, index: chunk_key(F.lit(1), F.lit(1), F.lit(0), F.lit(level), index)
    labels = rows.select("label").distinct()
    tops = labels.select((F.col("label") % 3).alias("top")).distinct()
    nodes = (
        rows.select(key(1, F.col("vec_id")).alias("chunk_key"), F.lit(1).alias("level"), F.lit(False).alias("is_summary"))
        .unionByName(labels.select(key(2, F.col("label")).alias("chunk_key"), F.lit(2).alias("level"), F.lit(True).alias("is_summary")))
        .unionByName(tops.select(key(3, F.col("top")).alias("chunk_key"), F.lit(3).alias("level"), F.lit(True).alias("is_summary")))
    )
    edges = (
        rows.select(key(1, F.col("vec_id")).alias("child_key"), key(2, F.col("label")).alias("parent_key"), F.lit(2).alias("level"))
        .unionByName(labels.select(key(2, F.col("label")).alias("child_key"), key(3, F.col("label") % 3).alias("parent_key"), F.lit(3).alias("level")))
    )
    return nodes.withColumn("series_id", F.lit(1)), edges


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of ``part`` as series, their parts as books; a series is a row, as its file has it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    book = F.struct(
        number.alias("number_in_series"), F.col("p_name").alias("title"), F.concat(F.lit("book_"), "p_partkey").alias("book_metadata_name"),
        F.col("p_size").alias("number_of_chapters"), F.lit(None).cast("string").alias("cover_image"),
    )
    none = F.array().cast("array<string>")
    made = part.select("p_brand", book.alias("b")).groupBy("p_brand").agg(F.array_sort(F.collect_list("b")).alias("books"))
    return made.select(
        F.substring("p_brand", 7, 9).cast("int").alias("series_id"), F.col("p_brand").alias("series_name"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("series_metadata_name"),
        F.struct(none.alias("names_to_skip"), none.alias("person_titles")).alias("entity_settings"), "books",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


CHUNKS = """chunks AS (
  SELECT doc_id, 1 AS series_id, CAST(dense_rank() OVER (ORDER BY source IS NULL, length(source), source) AS INTEGER) AS book_number,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chapter_number, 1 AS level, 0 AS chunk_index, text, lang
  FROM documents
), keyed AS (
  SELECT *, concat('series_', series_id, '|book_', book_number, '|chapter_', chapter_number, '|level_', level, '|chunk_', chunk_index) AS chunk_key FROM chunks
)"""
POSITIONED = (
    CHUNKS
    + """, positioned AS (
  SELECT *, round(sum(length(text)) OVER (PARTITION BY book_number ORDER BY chapter_number) / sum(length(text)) OVER (PARTITION BY book_number)::DOUBLE, 4) AS book_position FROM keyed
)"""
)
TREE = """node AS (
  SELECT concat('series_1|book_1|chapter_0|level_1|chunk_', vec_id) AS chunk_key, 1 AS level, false AS is_summary FROM embeddings
  UNION ALL SELECT DISTINCT concat('series_1|book_1|chapter_0|level_2|chunk_', label), 2, true FROM embeddings
  UNION ALL SELECT DISTINCT concat('series_1|book_1|chapter_0|level_3|chunk_', label % 3), 3, true FROM embeddings
), edge AS (
  SELECT concat('series_1|book_1|chapter_0|level_1|chunk_', vec_id) AS child_key, concat('series_1|book_1|chapter_0|level_2|chunk_', label) AS parent_key, 2 AS level FROM embeddings
  UNION ALL SELECT DISTINCT concat('series_1|book_1|chapter_0|level_2|chunk_', label), concat('series_1|book_1|chapter_0|level_3|chunk_', label % 3), 3 FROM embeddings
)"""
TURNS = """nxt AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), turns AS (
  SELECT conv_id AS conversation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sequence, text AS question, next_text AS response
  FROM nxt WHERE role = 'user' AND next_role = 'assistant'
)"""
