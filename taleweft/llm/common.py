"""Helpers shared by the training-data operators: row keys, working folders, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import stored, work_dir  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashable(field: T.StructField) -> Column:
    col = F.col(f"`{field.name.replace('`', '``')}`")
    return F.to_json(F.struct(col)) if "map<" in field.dataType.simpleString() or isinstance(field.dataType, T.VariantType) else col


def row_hash(df: DataFrame, seed: int) -> Column:
    """64-bit hash of every column of a row; rows that share it are taken as interchangeable.

    A null adds a marker, so that (null, x) and (x, null) differ.
    """
    parts = [F.lit(seed)]
    for field in df.schema.fields:
        col = _hashable(field)
        parts += [col.isNull(), col]
    return F.xxhash64(*parts)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that a result column replaces."""
    return df.drop(*names)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold ``max_bytes`` or are one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    return [x or "" for x in batch.column(text).to_pylist()]
