"""The memory view: time-stamped observations, whatever table they come from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows dealt over all tasks by a key, ahead of costly work on each row: a file of few row groups is read by few tasks."""
    return df.repartition(key)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: id, ts, us, app, session, project, value, props, day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        T.micros(F.col("ts").cast("timestamp_ntz")).alias("us"),
        F.col("event_type").alias("app"),
        F.col("user_id").cast("string").alias("session"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"),
        "value",
        "props",
        F.to_date("ts").alias("day"),
    )


def latest(df: DataFrame, column: str = "ts") -> datetime:
    """The clock of a table: its newest timestamp (one value)."""
    return df.agg(F.max(column)).first()[0]


#: The memory view in SQL.
MEMORIES = """WITH m AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, event_type AS app, CAST(user_id AS VARCHAR) AS session,
    'p' || (user_id % 7) AS project, value, props, CAST(ts AS DATE) AS day
  FROM events), clock AS (SELECT max(ts) AS now FROM m)
"""
