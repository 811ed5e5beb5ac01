"""Usage statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import time as T


def blank_as(c: Column, name: str = "Unknown") -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(name)).otherwise(c)


def unblank(c: Column) -> Column:
    """Null for blanks, so that they are not counted."""
    return F.nullif(F.trim(c), F.lit(""))


def counts(df: DataFrame, now: datetime) -> DataFrame:
    since = lambda d: F.count_if(F.col("ts") >= T.at(now - d))
    return df.agg(F.count("*").alias("total"), since(timedelta(hours=1)).alias("last_1h"), since(timedelta(hours=24)).alias("last_24h"), since(timedelta(days=7)).alias("last_7d"))


def span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.round((F.max("us") - F.min("us")) / 3.6e9, 6).alias("span_hours"))


def days(df: DataFrame, now: datetime) -> DataFrame:
    return df.agg(F.countDistinct("day").alias("active_days"), F.count_if(F.col("day") == F.lit(now.date())).alias("today"))


def dense(spark: SparkSession, df: DataFrame, slot: Column, n: int, name: str) -> DataFrame:
    """Counts of slots 0..n-1, zeros included."""
    have = df.groupBy(slot.cast("int").alias(name)).agg(F.count("*").alias("n"))
    return spark.range(n).select(F.col("id").cast("int").alias(name)).join(have, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dayparts(df: DataFrame) -> DataFrame:
    return df.groupBy(T.daypart(F.col("ts")).alias("part")).agg(F.count("*").alias("n"))


def busiest_hour(df: DataFrame) -> DataFrame:
    """The hour with most rows; of equals the last."""
    h = df.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return h.agg(F.max_by("hour", F.struct("n", "hour")).alias("hour"), F.max("n").alias("n"))


def extreme_days(df: DataFrame) -> DataFrame:
    """Busiest and quietest day; of equals the earliest."""
    d = df.groupBy("day").agg(F.count("*").alias("n"))
    return d.agg(F.min_by("day", F.struct(-F.col("n"), F.col("day"))).cast("string").alias("busiest"), F.max("n").alias("busiest_n"), F.min_by("day", F.struct("n", "day")).cast("string").alias("quietest"), F.min("n").alias("quietest_n"))


def top_values(df: DataFrame, c: Column, n: int = 10, blank: str | None = "Unknown") -> DataFrame:
    """The n most frequent values with their share; ties by value. blank: what blanks count as; None leaves them out."""
    v = blank_as(c, blank) if blank is not None else unblank(c)
    g = df.select(v.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    top = g.orderBy(F.desc("n"), "value").limit(n)
    return top.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total") * 100, 4).alias("share_pct"))  # total is one row


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(unblank(F.col(c))).alias(c) for c in columns])


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count(unblank(F.col(c))).alias(c) for c in columns])


def class_counts(df: DataFrame, c: Column, known: list[str]) -> DataFrame:
    """Rows of each known class, and of any other."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return df.agg(*[F.count_if(v == k).alias(k) for k in known], F.count_if(~v.isin(known)).alias("other"))


def quality(df: DataFrame, confidence: str, noise: str) -> DataFrame:
    c, n = F.greatest(F.col(confidence), F.lit(0.0)), F.greatest(F.col(noise), F.lit(0.0))
    return df.agg(F.round(F.avg(c), 6).alias("mean_confidence"), F.round(F.avg(n), 6).alias("mean_noise"), F.count_if((c > 0) & (c < 0.55)).alias("low_confidence"), F.count_if(n >= 0.40).alias("high_noise"))


def rates(df: DataFrame) -> DataFrame:
    hours = (F.max("us") - F.min("us")) / 3.6e9
    return df.agg(F.round(F.count("*") / F.countDistinct("day"), 6).alias("per_active_day"), F.round(F.when(hours > 0, F.count("*") / hours), 6).alias("per_hour"))


def timeline(df: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket: start, end, count, value of the last row, and its apps and projects in order of name."""
    return df.groupBy(bucket.alias("bucket")).agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.count("*").alias("n"),
        F.max_by("app", F.struct("us", "id")).alias("last_app"),
        F.array_join(F.array_sort(F.collect_set("app")), ",").alias("apps"),
        F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"),
    )


def clusters(df: DataFrame, per_app: int = 4) -> DataFrame:
    """Daily clusters of app and label: count, first, last; the rest of an app's clusters beyond ``per_app`` (longest span first) rolled into one."""
    g = df.groupBy("day", "app", "project").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    w = Window.partitionBy("day", "app").orderBy(F.desc(F.col("last_us") - F.col("first_us")), "project")
    g = g.withColumn("rank", F.row_number().over(w)).withColumn("label", F.when(F.col("rank") <= per_app, F.col("project")).otherwise("(rest)"))
    return g.groupBy("day", "app", "label").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")).withColumn("day", F.col("day").cast("string"))


def projects(df: DataFrame) -> DataFrame:
    return df.groupBy("project").agg(F.count("*").alias("n"), F.max("us").alias("last_us"), F.max_by("app", F.struct("us", "id")).alias("latest"))


def telemetry(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))


def card_scores(df: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: sum of score / (rank) over sum of 1 / rank, plus .04 a member, at most 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "id")
    r = df.withColumn("_r", F.row_number().over(w))
    v = F.sum(F.col(score) / F.col("_r")) / F.sum(1 / F.col("_r")) + 0.04 * F.count("*")
    return r.groupBy(group).agg(F.round(F.least(F.lit(1.0), v), 6).alias("card_score"), F.count("*").alias("n"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean precision@k, mean reciprocal rank@k, top-1 and top-5 hits over queries. ranked: query, id, rank; relevant: query, id."""
    hit = ranked.where(F.col("rank") <= k).join(relevant.withColumn("_rel", F.lit(1)), ["query", "id"], "left")
    per = hit.groupBy("query").agg(F.sum(F.coalesce("_rel", F.lit(0))).alias("h"), F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"))
    return per.agg(
        F.round(F.avg(F.col("h") / k), 6).alias("precision"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("first") == 1).alias("top1"), F.count_if(F.col("first") <= 5).alias("top5")
    )
