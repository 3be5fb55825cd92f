"""Tables written once and read many times: parsed events, before everything that is computed from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet (to ``path``, or to the shared folder until the session ends) and read again: lineage ends there.

    Unlike ``checkpoint()``, this computes the rows once.
    """
    spark = df.sparkSession
    place = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    if path is None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(place)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(place)
