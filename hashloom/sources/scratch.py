"""Folders and tables for intermediate data, below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a temporary one is set for a local master (tests), and a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there: a cut lineage that survives lost executors."""
    path = folder(df.sparkSession)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.parquet(path) if partitions else df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, column: str, rows: int = 50_000, most: int = 20_000) -> DataFrame:
    """The rows, stored, with the number of their range in ``range``: up to ``most`` ranges of the column's values, sampled so that each holds about as many rows (``rows`` in general)."""
    ranges = min(most, max(1, -(-df.count() // rows)))
    return stored(df.repartitionByRange(ranges, column).select("*", F.spark_partition_id().alias("range")))
