"""Working folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes with the application.

    Only where all of Spark is one process (``local`` masters, as in tests) may the setting be
    absent: the folder is then below the temporary one. A cluster without it is an error, as
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/taleweft"
    path = f"{base.rstrip('/')}/taleweft-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a working folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
