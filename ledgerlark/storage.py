"""The folder that the driver and all executors share, for tables that are written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where master is in this process (tests, benches)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local") or "local-cluster" in spark.conf.get("spark.master"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="ledgerlark-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: what stands before them is not run again, nor lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
