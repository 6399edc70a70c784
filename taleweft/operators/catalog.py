"""Series and characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def books(series: DataFrame) -> DataFrame:
    return series.select("series_id", "series_name", "series_metadata_name", F.inline("books"))


def find_series(series: DataFrame, name: str) -> DataFrame:
    """The first series of that name or metadata name, if any."""
    return series.filter((F.col("series_name") == name) | (F.col("series_metadata_name") == name)).orderBy("series_id").limit(1)


def find_all_series(series: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, series_id) for each distinct ``name``: the first series by id of that name or metadata name; none for others."""
    known = series.select("series_id", F.explode(F.array_distinct(F.array("series_name", "series_metadata_name"))).alias("asked"))
    return names.select(F.col("name").alias("asked")).distinct().join(known, "asked").groupBy("asked").agg(F.min("series_id").alias("series_id"))


def series_json(series: DataFrame) -> DataFrame:
    """(series_id, json) without the entity settings."""
    return series.select("series_id", F.to_json(F.struct("series_id", "series_name", "series_metadata_name", "books"), {"ignoreNullFields": "false"}).alias("json"))


def add_aliases(characters: DataFrame, new: DataFrame) -> DataFrame:
    """Characters (character_id, name, aliases) with aliases added, and new ones made; a name is its own first alias."""
    both = characters.select("character_id", "name", F.lit(0).alias("__o"), "aliases").unionByName(new.select("character_id", "name", F.lit(1).alias("__o"), "aliases"))
    merged = both.groupBy("character_id").agg(F.min_by("name", "__o").alias("name"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__o", "aliases"))), lambda x: x["aliases"])).alias("__a"))
    return merged.select("character_id", "name", F.array_distinct(F.concat(F.array("name"), F.coalesce("__a", F.array().cast("array<string>")))).alias("aliases"))


def add_summaries(summaries: DataFrame) -> DataFrame:
    """(character_id, book, chapter, summaries): lists in order of ``position``."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "summary")))
    return summaries.groupBy("character_id", "book", "chapter").agg(F.transform(ordered, lambda x: x["summary"]).alias("summaries"))


def find_characters(characters: DataFrame, names: DataFrame, order: str = "character_id") -> DataFrame:
    """For each ``name`` asked: the first character, by a column that tells the order of insertion, that has it as name or alias, in any case."""
    every = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.lower(a)))
    known = characters.select("character_id", F.col("name").alias("found"), F.col(order).alias("__o"), F.explode(every).alias("__a"))
    first = known.groupBy("__a").agg(F.min_by(F.struct("character_id", "found"), F.struct("__o", "character_id")).alias("c"))  # before the join, so a common alias is one row
    return names.select(F.col("name").alias("asked")).distinct().join(first, F.lower("asked") == F.col("__a")).select("asked", "c.character_id", "c.found")
