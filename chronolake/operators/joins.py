"""Joins that the data model needs beyond plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the intervals that hold them (both ends included).

    Both sides are cut into buckets of ``width``; an interval is repeated for each
    bucket it touches, buckets are joined by equality and the bounds checked again.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    i = intervals.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return p.join(i, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_b")


def neighbours(df: DataFrame, key: str, at: str, span: int, k: int) -> DataFrame:
    """For each row the k nearest other rows of its key within ``span``: id, neighbour, gap, rank."""
    a = df.select("id", key, F.col(at).alias("_t"))
    b = df.select(F.col("id").alias("neighbour"), F.col(key).alias("_k"), F.col(at).alias("_u"), F.floor(F.col(at) / span).cast("long").alias("_b"))
    a = a.withColumn("_b", F.explode(F.array(*[(F.floor(F.col("_t") / span) + d).cast("long") for d in (-1, 0, 1)])))
    pairs = a.join(b, (a[key] == b["_k"]) & (a["_b"] == b["_b"])).where((F.col("id") != F.col("neighbour")) & (F.abs(F.col("_t") - F.col("_u")) <= span))
    w = Window.partitionBy("id").orderBy(F.abs(F.col("_t") - F.col("_u")), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbour", F.abs(F.col("_t") - F.col("_u")).alias("gap"), "rank")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, take: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key at or before it (an extension; null if there is none)."""
    l = left.withColumns({"_r": F.lit(1), **{f"_{c}": F.lit(None).cast(dict(right.dtypes)[c]) for c in take}})
    r = right.select(key, at, F.lit(0).alias("_r"), *[F.col(c).alias(f"_{c}") for c in take])
    w = Window.partitionBy(key).orderBy(at, "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    last = F.last(F.when(F.col("_r") == 0, F.struct(*[F.col(f"_{c}").alias(c) for c in take])), ignorenulls=True).over(w)
    return both.withColumn("_x", last).where("_r = 1").select(*left.columns, *[F.col(f"_x.{c}").alias(f"asof_{c}") for c in take])


def either_end(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which at least one end is in ids."""
    s = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    t = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return s.unionByName(t).distinct()


def both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def parent_chain(df: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, ancestor, hops) up to ``depth`` hops; a row seen before ends its chain. df: id, parent."""
    step = start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("hops"), F.array("id").alias("_seen"))
    out = step
    up = df.select(F.col("id").alias("ancestor"), F.col("parent").alias("_p"))
    for _ in range(depth):
        step = step.join(up, "ancestor").where(F.col("_p").isNotNull() & ~F.array_contains("_seen", F.col("_p"))).select("id", F.col("_p").alias("ancestor"), (F.col("hops") + 1).alias("hops"), F.concat("_seen", F.array("_p")).alias("_seen"))
        out = out.unionByName(step)
    return out.drop("_seen")


def redirected(df: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """Replace ids by the ids they were merged into. redirects: old, new."""
    return df.join(redirects.withColumnRenamed("old", column), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def pruned_lists(df: DataFrame, column: str, live: DataFrame) -> DataFrame:
    """Keep in each row's list only ids that are in live (id), in order."""
    items = df.select("id", F.posexplode(column).alias("_i", "_v")).join(live.withColumnRenamed("id", "_v"), "_v", "left_semi")
    lists = items.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("_l"))
    return df.join(lists, "id", "left").withColumn(column, F.coalesce("_l", F.array().cast(dict(df.dtypes)[column]))).drop("_l")


def _blocks(df: DataFrame, key: list[str], size: int = 256) -> DataFrame:
    """The rows of each key in blocks of about ``size``: key, ids (null ids stay) and a number of the block.

    The pairs of two blocks are in memory at once where they are exploded, so blocks are small.
    """
    counts = df.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.ceil(F.count("*") / size).cast("long").alias("_of"))
    x = df.join(counts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_of")))
    return x.groupBy(*key, "block").agg(F.transform(F.collect_list(F.struct("id")), lambda s: s["id"]).alias("ids"))


def _paired(x: DataFrame, y: DataFrame, key: str, tasks: int = 192, side: int = 4) -> DataFrame:
    """Blocks of x with the blocks of y of the same key, dealt over a square of tasks; pairs of blocks are never shuffled, a block is sent ``side`` times."""
    mine = lambda c: F.pmod(F.xxhash64(f"{c}_block", f"{c}_name"), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    x = x.withColumns({"across": mine("x")}).withColumn("down", every).repartition(tasks, key, "across", "down")
    y = y.withColumns({"down": mine("y")}).withColumn("across", every).repartition(tasks, key, "across", "down")
    return x.join(y, [key, "across", "down"])


def contradictions(df: DataFrame, negative: Column) -> DataFrame:
    """Pairs a < b of one project of which exactly one is negative. df: id, project."""
    x = df.select("id", "project", negative.alias("neg"))
    x = _blocks(x.where("project is not null and neg is not null"), ["project", "neg"])
    yes, no = (x.where(f"neg = {v}").select("project", F.col("block").alias(f"{c}_block"), F.lit(0).alias(f"{c}_name"), F.col("ids").alias(f"{c}_ids")) for c, v in (("x", "true"), ("y", "false")))
    pairs = _paired(yes, no, "project").select("project", F.explode("x_ids").alias("u"), "y_ids").select("project", "u", F.explode("y_ids").alias("v"))
    return pairs.select("project", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def related(pages: DataFrame) -> DataFrame:
    """Pairs a < b that share an entity and the topic. pages: id, topic, entities.

    Rows of the same keys (topic and entity) form a class, cut into blocks. Blocks
    meet at each key they share and pass at the first of those, so that a pair comes
    once and neither pairs of blocks nor pairs of rows are shuffled.
    """
    e = pages.where("id is not null and topic is not null").select("id", F.explode("entities").alias("entity"), "topic").where("entity is not null")
    rows = e.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("topic", "entity"))).alias("keys"))
    b = _blocks(rows, ["keys"]).withColumn("name", F.array_min("ids"))
    x, y = (b.select(*[F.col(c).alias(f"{s}_{c}") for c in b.columns], F.explode("keys").alias("key")) for s in "xy")
    met = _paired(x, y, "key").where((F.col("x_name") <= F.col("y_name")) & (F.array_intersect("x_keys", "y_keys")[0] == F.col("key")))
    pairs = met.select(F.explode("x_ids").alias("u"), "y_ids", (F.col("x_name") < F.col("y_name")).alias("apart")).select("u", F.explode("y_ids").alias("v"), "apart")
    u, v = F.col("u"), F.col("v")
    return pairs.where(F.col("apart") | (u < v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))


def with_reasons(evidence: DataFrame, selected: DataFrame, private: Column, cap: int) -> DataFrame:
    """id and reason: kept, not_selected, private or over_cap (rank by score desc, id)."""
    x = evidence.join(selected.withColumn("_s", F.lit(True)), "id", "left").withColumn("reason", F.when(F.col("_s").isNull(), "not_selected").when(private, "private"))
    w = Window.partitionBy(F.col("reason").isNull(), "source").orderBy(F.desc("score"), "id")
    return x.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(w) <= cap, "kept").otherwise("over_cap"))).select("id", "reason")


def children(df: DataFrame, parent: str, ids: DataFrame) -> DataFrame:
    """The direct children of the rows in ids (id); rows without parent are no one's."""
    return df.join(ids.select(F.col("id").alias(parent)).distinct(), parent, "left_semi")
