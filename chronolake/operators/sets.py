"""Set operations, ranking and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def branch_union(branches: dict[str, DataFrame], lists: list[str] = ()) -> DataFrame:
    """Union of branches: per id the best score of each and overall, and lists merged."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.withColumn("branch", F.lit(k)) for k, b in branches.items()])
    return u.groupBy("id").agg(F.max("score").alias("score"), *[F.max(F.when(F.col("branch") == k, F.col("score"))).alias(k) for k in branches], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])


def keep_first(df: DataFrame, key, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def difference(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("us"), "id").limit(n)


def tail_ascending(df: DataFrame, n: int) -> DataFrame:
    """The newest n, oldest first."""
    return newest(df, n).orderBy("us", "id")


def split_top(df: DataFrame, flag, weight: str, each: int) -> DataFrame:
    """The heaviest ``each`` rows of those flagged and of the rest."""
    order = [F.desc(weight), F.col("id")]
    return df.where(flag).orderBy(*order).limit(each).unionByName(df.where(~flag).orderBy(*order).limit(each))


def clamp_limit(n: int | None, most: int = 50, default: int = 20) -> int:
    return max(1, min(most, default if n is None else n))


# What a task's origin adds to its priority.
ORIGIN = {"manual": 22, "meeting": 16, "memory": 11}


def task_priority(age_hours, memories, urls, due, origin, supported, low_signal):
    """A task's score: recency in 96 hours, linked memories and urls, due date and origin, less what weak tasks lose."""
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in ORIGIN.items() for x in kv])[origin], F.lit(6))
    recent = F.greatest(F.lit(0), F.least(F.lit(96), 96 - F.greatest(age_hours, F.lit(0))))
    weak = F.when(~supported & ~origin.isin("manual", "meeting"), 18).otherwise(0) + F.when(low_signal, 24).otherwise(0)
    return recent + F.least(memories, F.lit(10)) * 4 + F.least(urls, F.lit(6)) * 2 + F.when(due, 12).otherwise(0) + bonus - weak
