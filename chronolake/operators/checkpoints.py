"""Cutting lineage in loops by reliable checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the session's spark.checkpoint.dir; where that is unset (tests, one machine) into a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="chronolake-"))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the session's spark.checkpoint.dir, for tables that a query writes; a temporary folder where that is unset (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="chronolake-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
