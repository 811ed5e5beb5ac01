"""Sequential operators: previous row, gaps, islands, sessions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def previous_row(df: DataFrame, order: list[str], take: list[str], bucket: str) -> DataFrame:
    """Add prev_<c> for each c of ``take``: the value in the row before, in the order of the whole table.

    ``bucket`` must rise with the order (a day, say). Rows look back inside their
    bucket; only a bucket's first row looks at the last row of the bucket before, of
    which there is one each. So no task gets the whole table.
    """
    inside = Window.partitionBy(bucket).orderBy(*order)
    out = df
    for c in take:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(inside))
    out = out.withColumn("_first", F.row_number().over(inside) == 1)
    tails = df.groupBy(bucket).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_tail"))
    tails = tails.withColumn("_before", F.lag("_tail").over(Window.orderBy(bucket))).select(bucket, "_before")
    out = out.join(tails, bucket, "left")
    for c in take:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")))
    return out.drop("_before", "_first")


def running_total(df: DataFrame, value: Column, order: list[str], bucket: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to this one in the whole table's order, by buckets as in previous_row."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(bucket).agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(bucket, "_base")
    return df.withColumn("_in", F.sum("_v").over(inside)).join(sums, bucket).withColumn(name, F.col("_base") + F.col("_in")).drop("_v", "_in", "_base")


def switches(df: DataFrame, key: str = "app") -> DataFrame:
    """Number of rows whose key differs from that of the row before, and that per hour of the span."""
    p = previous_row(df.select("us", "id", "day", key), ["us", "id"], [key], "day")
    n = F.count_if(F.col(f"prev_{key}").isNotNull() & (F.col(f"prev_{key}") != F.col(key)))
    hours = (F.max("us") - F.min("us")) / 3.6e9
    return p.agg(n.alias("switches"), F.round(F.when(hours > 0, n / hours), 6).alias("per_hour"))


def gap_stats(df: DataFrame) -> DataFrame:
    """Mean of the positive gaps in minutes and the longest gap in whole minutes, over all rows in time order."""
    p = previous_row(df.select("us", "id", "day"), ["us", "id"], ["us"], "day").withColumn("gap", F.col("us") - F.col("prev_us"))
    return p.agg(F.round(F.avg(F.when(F.col("gap") > 0, F.col("gap") / 6e7)), 6).alias("mean_gap_min"), F.floor(F.max("gap") / 6e7).cast("long").alias("longest_gap_min"))


def streaks(df: DataFrame, key: str) -> DataFrame:
    """Longest run of consecutive active days and the run that ends at the last active day, by key."""
    days = df.select(key, "day").distinct()
    w = Window.partitionBy(key).orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(w))).groupBy(key, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"))


def active_minutes(df: DataFrame, key: str = "app", cap_s: int = 300, floor_s: int = 30) -> DataFrame:
    """Per key: the sum of the gaps to its previous row, each at most ``cap_s``, at least ``floor_s`` in all, in minutes."""
    gap = F.least((F.col("us") - F.col("prev_us")) / 1e6, F.lit(float(cap_s)))
    p = _previous_by_key(df.select(key, "us", "id", "day"), key, ["us"])
    return p.groupBy(key).agg((F.greatest(F.coalesce(F.sum(gap), F.lit(0.0)), F.lit(float(floor_s))) / 60).alias("minutes")).select(key, F.round("minutes", 4).alias("minutes"))


def _previous_by_key(df: DataFrame, key: str, take: list[str]) -> DataFrame:
    """As previous_row, inside each key: buckets are (key, day), so that a common key is spread over its days."""
    w = Window.partitionBy(key, "day").orderBy("us", "id")
    out = df
    for c in take:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    out = out.withColumn("_first", F.row_number().over(w) == 1)
    tails = df.groupBy(key, "day").agg(F.max_by(F.struct(*take), F.struct("us", "id")).alias("_tail"))
    tails = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy(key).orderBy("day"))).select(key, "day", "_before")
    out = out.join(tails, [key, "day"])
    for c in take:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")))
    return out.drop("_before", "_first")


def sessions(df: DataFrame, keys: list[str], gap_minutes: int = 20) -> DataFrame:
    """Session number of every row in global time order: a new one at a change of any key or a gap over the limit."""
    p = previous_row(df, ["us", "id"], ["us", *keys], "day")
    new = F.col("prev_us").isNull() | ((F.col("us") - F.col("prev_us")) > gap_minutes * 60_000_000)
    for k in keys:
        new = new | ~F.col(f"prev_{k}").eqNullSafe(F.col(k))
    return running_total(p, new.cast("long"), ["us", "id"], "day", "session_no").drop("prev_us", *[f"prev_{k}" for k in keys])


def best_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def min_max_scaled(df: DataFrame, column: str, name: str, by: list[str]) -> DataFrame:
    """Scaled to 0..1 inside ``by``; where all values are equal: 1 if positive, else 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    scaled = F.when(high - low > 1e-9, (F.col(column) - low) / (high - low)).otherwise(F.when(F.col(column) > 0, 1.0).otherwise(0.0))
    return df.withColumn(name, scaled)


def runs_of(df: DataFrame, flag: Column, key: str, least: int) -> DataFrame:
    """Rows at which ``flag`` has held ``least`` times running, by key in time order."""
    w = Window.partitionBy(key).orderBy("us", "id")
    before = w.rowsBetween(-(least - 1), 0)
    return df.withColumn("_f", flag.cast("int")).withColumn("_s", F.sum("_f").over(before)).withColumn("_c", F.count("*").over(before)).where(f"_s = {least} AND _c = {least}").drop("_f", "_s", "_c")


def islands(df: DataFrame, key: list[str], span_us: int) -> DataFrame:
    """df with _part, the day (since 1970) on which the row's island begins: a row more than ``span_us`` after its key's row before begins one.

    A rule that lets a row join its group's first row within that span never joins
    rows of two islands, so the islands that begin on a day can be worked alone.
    """
    w = Window.partitionBy(*key).orderBy("us", "id")
    gap = F.col("us") - F.lag("us").over(w)
    start = F.when(F.coalesce(gap > span_us, F.lit(True)), F.col("us"))
    return df.withColumn("_start", start).withColumn("_part", F.floor(F.last("_start", ignorenulls=True).over(w) / 86_400_000_000)).drop("_start")


def spans(df: DataFrame, key: list[str], span_us: int, *order) -> DataFrame:
    """df with _no, the number (from 0) of each row's span in its key, and _new, whether the row begins it.

    Rows come in ``order``; one more than ``span_us`` from its span's first row begins
    the next. Each task passes over its keys' sorted rows in batches and carries one
    row, so neither many small keys nor a long one cost a call or memory. Rows
    without us take no part.
    """

    def f(batches):
        now, first, no = None, None, -1
        for b in batches:
            numbers, new = [], []
            for k, us in zip(zip(*[b.column(c).to_pylist() for c in key]), b.column("us").to_pylist()):
                if k != now:
                    now, first, no = k, None, -1
                begins = first is None or abs(us - first) > span_us
                if begins:
                    first, no = us, no + 1
                numbers.append(no)
                new.append(begins)
            columns = [*b.columns, pa.array(numbers, pa.int64()), pa.array(new, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "_no", "_new"])

    rows = df.where("us is not null").repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInArrow(f, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", _no long, _new boolean")


def anchored_groups(df: DataFrame, key: str, minutes: int = 5) -> DataFrame:
    """Greedy groups by key, newest first: a row joins while it is within ``minutes`` of the group's first row.

    part is the day on which the row's island begins; group_no counts inside part.
    """
    rows = islands(df.select("id", key, "us"), [key], minutes * 60_000_000).withColumnRenamed("_part", "part")
    return spans(rows, [key, "part"], minutes * 60_000_000, F.desc("us"), "id").select("id", key, "part", F.col("_no").alias("group_no"))


def switch_alerts(df: DataFrame, key: str, ring: int = 15, least_rows: int = 8, least_distinct: int = 6) -> DataFrame:
    """Rows at which the last ``ring`` apps of a key number at least least_rows, with least_distinct different ones."""
    w = Window.partitionBy(key).orderBy("us", "id").rowsBetween(-(ring - 1), 0)
    return df.withColumn("_r", F.collect_list("app").over(w)).where((F.size("_r") >= least_rows) & (F.size(F.array_distinct("_r")) >= least_distinct)).drop("_r")


def ewma(df: DataFrame, key: str, value: str, alpha: float = 0.125) -> DataFrame:
    """Exponentially weighted mean of a key's values in time order; the first value starts it."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("us", "id", F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy(key).agg(seq.alias("_s")).select(key, F.round(F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), F.element_at("_s", 1), lambda a, x: a + alpha * (x - a)), 6).alias("ewma"))


# Under both of these a group is cut.
LEAST_ENTITIES, LEAST_WORDS = 0.35, 0.20


def split_groups(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with part, numbered from 1 inside each group: a row begins a new part if it shares too few entities and words with the row before.

    df: entities (array), title, summary, text. A row without entities has the words
    of its title and summary instead.
    """
    words = lambda c: F.array_distinct(F.filter(X.words(F.coalesce(c, F.lit(""))), lambda w: F.octet_length(w) > 2))
    named = F.array_distinct(F.filter(F.transform("entities", X.normalise), lambda e: e != ""))
    own = F.when(F.size("entities") > 0, named).otherwise(words(F.concat_ws(" ", "title", "summary")))
    w = Window.partitionBy(group).orderBy(*order)
    x = df.withColumns({"_e": own, "_w": words(F.col("text"))}).withColumns({"_pe": F.lag("_e").over(w), "_pw": F.lag("_w").over(w)})
    cut = F.col("_pe").isNotNull() & (X.jaccard(F.col("_e"), F.col("_pe")) < LEAST_ENTITIES) & (X.jaccard(F.col("_w"), F.col("_pw")) < LEAST_WORDS)
    return x.withColumn("_c", cut.cast("int")).withColumn("part", (1 + F.sum("_c").over(w)).cast("long")).drop("_e", "_w", "_pe", "_pw", "_c")
