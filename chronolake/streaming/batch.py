"""Batch forms of the streaming rules, for history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import best_per_key, spans


def sliding_dedup(df: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """Rows whose key did not occur within ``seconds`` before (every occurrence renews)."""
    gap = F.col("us") - F.lag("us").over(Window.partitionBy(*key).orderBy("us", "id"))
    return df.withColumn("_g", gap).where(F.col("_g").isNull() | (F.col("_g") > seconds * 1_000_000)).drop("_g")


def tumbling_dedup(df: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """Rows that begin a span of ``seconds`` of their key; the next span begins with the first row after it."""
    return spans(df, key, seconds * 1_000_000, "us", "id").where("_new").drop("_no", "_new")


def insert_dedup(df: DataFrame, key: str, signal: str) -> DataFrame:
    """One row of a content key: the higher signal, then the newer."""
    return best_per_key(df, [key], [F.desc(signal), F.desc("us"), F.col("id")])


def merged(df: DataFrame, anchor: str, lists: list[str] = (), scores: list[str] = (), texts: list[str] = ()) -> DataFrame:
    """One record for each anchor: newest filled text, union of lists, best scores, first and last time, count."""
    newest = lambda c: F.max_by(c, F.when(F.trim(F.col(c)) != "", F.struct("us", "id")))
    return df.groupBy(anchor).agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count("*").alias("n"),
        *[newest(c).alias(c) for c in texts],
        *[F.max(c).alias(c) for c in scores],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
    )


def review_queue(df: DataFrame) -> DataFrame:
    """First-in order, each id once."""
    return df.groupBy("id").agg(F.min("us").alias("us")).orderBy("us", "id")


def changes_since(df: DataFrame, baseline_us: int, newest: int = 24) -> DataFrame:
    """Of the newest rows, those after the baseline (the limit comes first)."""
    return df.orderBy(F.desc("us"), "id").limit(newest).where(F.col("us") > baseline_us)
