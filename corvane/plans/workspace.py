"""Folders for streams' checkpoints and tables, in the folder that driver and executors share. They go when the driver ends."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        there = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex) if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh() named; if the session is gone already, it stays to its owner."""
    try:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the driver is ending
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, for what a plan would compute more than once."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
