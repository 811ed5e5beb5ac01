"""Search in stages: keyword variants under a budget, and routes in two waves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from .checkpoints import cut, new_folder

# Variants after the first, what a later variant's scores lose, the hits that end the search.
FALLBACKS, LOSS, LEAST_SHARE, HITS = 3, 0.07, 0.84, (8, 18)
# Seeds that each route gives to the graph route (None: all), the share of the seed's score, the hits kept.
SEEDS, SEED_SHARE, GRAPH_HITS = {"vector": 5, "keyword": 5, "entity": None}, 0.58, 25


def variant_search(df: DataFrame, variants: list[str], fields: dict[str, str], recency: Column, limit: int, time: str = "us", fallbacks: int = FALLBACKS) -> DataFrame:
    """id, score, variant: keyword hits of the first variant, and of later ones as long as the ones before gave too few.

    One scan scores a row for all variants; each variant keeps its ``limit`` best.
    Variant i counts if those before it have fewer than min(limit, 18) different
    rows, at least 8; its scores are times max(.84, 1 - .07 i). A row keeps its best
    score; ties go to the newer row. df: id, ``time`` and the fields.
    """
    variants = variants[: fallbacks + 1]
    if not variants:
        return df.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("variant")).limit(0)
    low = {k: F.lower(F.coalesce(F.col(c), F.lit(""))) for k, c in fields.items()}
    rated = []
    for i, text in enumerate(variants):
        p = R.Profile(text)
        terms = p.primary + p.numbers
        score = (0.86 * R.lexical_score({k: F.col(c) for k, c in fields.items()}, terms, p.phrase) + 0.14 * recency) * max(LEAST_SHARE, 1 - LOSS * i)
        found = R._any([c.contains(t) for c in low.values() for t in terms])
        rated.append(F.struct(F.lit(i).alias("variant"), F.when(found, score).alias("score")))
    hits = df.select("id", time, F.explode(F.array(*rated)).alias("v")).select("id", F.col(time).alias("_at"), "v.*").where("score is not null")
    best = Window.partitionBy("variant").orderBy(F.desc("score"), F.desc("_at"), "id")
    hits = cut(hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n"))  # len(variants) * limit rows at most
    target = max(HITS[0], min(HITS[1], limit))
    firsts = hits.groupBy("id").agg(F.min("variant").alias("variant")).groupBy("variant").agg(F.count("*").alias("new"))
    stages = hits.sparkSession.range(len(variants)).select(F.col("id").cast("int").alias("variant")).join(firsts, "variant", "left").na.fill(0, ["new"])
    known = F.coalesce(F.sum("new").over(Window.partitionBy(F.lit(0)).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = stages.select("variant", ((known < target) | (F.col("variant") == 0)).alias("on"))
    stop = used.agg(F.min(F.when(~F.col("on"), F.col("variant"))).alias("stop"))
    kept = hits.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("variant") < F.col("stop")))  # one row
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("_at"), "variant")
    out = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return out.orderBy(F.desc("score"), F.desc("_at"), "id").limit(limit).select("id", "score", "variant")


def graph_seeds(hits: DataFrame) -> DataFrame:
    """(id, score): the rows that start the graph route. hits: id, score, route."""
    w = Window.partitionBy("route").orderBy(F.desc("score"), "id")
    top = F.create_map(*[F.lit(x) for k, v in SEEDS.items() if v for x in (k, v)])[F.col("route")]
    rows = hits.where(F.col("route").isin(list(SEEDS))).withColumn("_n", F.row_number().over(w)).where(top.isNull() | (F.col("_n") <= top))
    return rows.groupBy("id").agg(F.max("score").alias("score"))


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, hops, confidence, path) of all nodes within ``hops`` of each start (id): fewest hops, then the best least confidence, then the least path."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "edge_type", "confidence")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_type", "confidence"))
    front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.lit(1.0).alias("conf"), F.array().cast("array<string>").alias("path"))
    seen = front
    for h in range(1, hops + 1):
        step = front.join(both, front.id == both.a).select("start", F.col("b").alias("id"), F.lit(h).alias("hops"), F.least("conf", "confidence").alias("conf"), F.concat("path", F.array(F.concat_ws(" ", F.col("a").cast("string"), "edge_type", F.col("b").cast("string")))).alias("path"))
        step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        w = Window.partitionBy("start", "id").orderBy(F.desc("conf"), "path")
        front = cut(step.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
        seen = seen.unionByName(front)
    return seen.where("hops > 0").withColumnRenamed("conf", "confidence")


def graph_hits(seeds: DataFrame, members: DataFrame, edges: DataFrame, hops: int, allowed: list[str] = (), factor: DataFrame | None = None) -> DataFrame:
    """(id, score, path): records of nodes near the seeds' nodes, the 25 best.

    .58 of the seed's score and .42 of the path's confidence, times the reached
    node's factor. seeds: id, score; members: node, id (records of each node);
    factor: node, factor. A node needs only its best two seeds, since a seed does
    not reach itself, so a node of very many seeds costs no more than others.
    """
    edges = edges.where(F.col("edge_type").isin(list(allowed))) if allowed else edges
    w = Window.partitionBy("node").orderBy(F.desc("score"), "id")
    held = members.join(seeds, "id").withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    starts = held.groupBy("node").agg(F.max(F.when(F.col("_n") == 1, F.struct("id", "score"))).alias("one"), F.max(F.when(F.col("_n") == 2, F.struct("id", "score"))).alias("two"))
    near = reach(edges, starts.select(F.col("node").alias("id")), hops).join(starts.withColumnRenamed("node", "start"), "start")
    if factor is not None:
        near = near.join(factor.withColumnRenamed("node", "id"), "id", "left")
    near = near.withColumn("_f", F.coalesce("factor", F.lit(1.0)) if factor is not None else F.lit(1.0)).withColumnRenamed("id", "node")
    rows = near.join(members, "node").withColumn("_s", F.when(F.col("one.id") == F.col("id"), F.col("two.score")).otherwise(F.col("one.score"))).where("_s is not null")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = unit(unit(F.col("_s") * SEED_SHARE + F.col("confidence") * (1 - SEED_SHARE)) * F.col("_f"))
    best = rows.withColumn("score", score).groupBy("id").agg(F.max("score").alias("score"), F.min_by("path", F.struct((-F.col("score")).alias("s"), "path")).alias("path"))
    return best.orderBy(F.desc("score"), "id").limit(GRAPH_HITS)


def dispatch(spark, requested: list[str], routes: dict[str, Callable[[], DataFrame]], graph: Callable[[DataFrame], DataFrame] | None = None, failed: list[str] | None = None) -> DataFrame:
    """id, score, route and path of all requested routes.

    First wave: every route but the graph's; each is stored under a new folder. A
    route that fails or is unknown is left out and named in ``failed``. Second wave:
    ``graph`` gets the seeds out of the stored first wave.
    """
    at, done, failed = new_folder(spark, "routes"), [], [] if failed is None else failed
    shape = "id long, score double, route string, path array<string>"

    def keep(route: str, run: Callable[[], DataFrame]) -> None:
        try:
            df = run()
            path = F.col("path") if "path" in df.columns else F.lit(None).cast("array<string>")
            df.select(F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.lit(route).alias("route"), path.alias("path")).write.mode("overwrite").parquet(f"{at}/{route}")
            done.append(route)
        except (PySparkException, KeyError, ValueError):
            failed.append(route)

    stored = lambda: spark.read.schema(shape).parquet(*[f"{at}/{r}" for r in done]) if done else spark.createDataFrame([], shape)
    for route in dict.fromkeys(r for r in requested if r != "graph"):
        keep(route, lambda: routes[route]())
    if "graph" in requested and graph is not None:
        keep("graph", lambda: graph(graph_seeds(stored())))
    return stored()
