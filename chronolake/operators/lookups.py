"""Lookups round the graph, tasks and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

# The least length of a vector in node search; minutes of a look back (recent changes, active focus), rows of the focus; nodes, edges and conflicts of an insight context.
LEAST_NORM, CHANGES, FOCUS, FOCUS_ROWS, INSIGHT = 1e-6, (1, 10_080), (1, 1_440), 30, (5, 3, 8)


def nodes_like(nodes: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nodes (at least one) of the best cosine with a vector; nodes of another dimension take no part. nodes: id, embedding."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = max(LEAST_NORM, sum(x * x for x in query) ** 0.5)
    sim = V.dot(F.col("embedding"), q) / (F.greatest(V.norm(F.col("embedding")), F.lit(LEAST_NORM)) * size)
    return nodes.where(F.size("embedding") == len(query)).withColumn("similarity", sim).orderBy(F.desc("similarity"), "id").limit(max(1, k))


def node_named(nodes: DataFrame, label: str, kind: str) -> DataFrame:
    """The node of a label and kind; of several the one of the largest id."""
    return nodes.where((F.col("label") == label) & (F.col("kind") == kind)).orderBy(F.desc("id")).limit(1)


def task_links(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, label; edges: source, target, reason) of tasks. tasks: id, title, memory, linked (ids), urls."""
    me = F.concat(F.lit("task:"), F.col("id").cast("string"))
    url = lambda x: F.concat(F.lit("url:"), x)
    memory = lambda x: F.concat(F.lit("memory:"), x.cast("string"))
    node = lambda id, kind, label: F.struct(id.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    edge = lambda target, reason: F.struct(me.alias("source"), target.alias("target"), F.lit(reason).alias("reason"))
    nodes = tasks.select(F.explode(F.concat(F.array(node(me, "Task", F.col("title"))), F.transform("urls", lambda u: node(url(u), "Url", u)))).alias("n")).select("n.*").distinct()
    own = F.when(F.col("memory").isNotNull(), F.array(edge(memory(F.col("memory")), "source_memory"))).otherwise(F.array().cast("array<struct<source:string,target:string,reason:string>>"))
    edges = F.concat(own, F.transform("linked", lambda m: edge(memory(m), "linked_memory")), F.transform("urls", lambda u: edge(url(u), "linked_url")))
    return nodes, tasks.select(F.explode(edges).alias("e")).select("e.*").distinct()


def related_urls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, url) of every task's url nodes."""
    urls = nodes.where("kind = 'Url'").select(F.col("id").alias("target"), F.col("label").alias("url"))
    return edges.join(urls, "target").select(F.col("source").alias("task"), "url").distinct()


def tasks_of_similar(near: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, task, votes): the tasks that refer to a row's similar rows. near: id, peer."""
    tasks = nodes.where("kind = 'Task'").select(F.col("id").alias("source"))
    refers = edges.where("reason in ('source_memory', 'linked_memory')").join(tasks, "source", "left_semi").select(F.col("source").alias("task"), "target").distinct()
    return near.withColumn("target", F.concat(F.lit("memory:"), F.col("peer").cast("string"))).join(refers, "target").groupBy("id", "task").agg(F.count("*").alias("votes"))


def node_rows(nodes: DataFrame, memories: DataFrame) -> DataFrame:
    """(node, id) and the record of every source id of nodes; a missing record stays with null fields. nodes: id, sources."""
    return nodes.select(F.col("id").alias("node"), F.explode("sources").alias("id")).where(F.trim(F.col("id").cast("string")) != "").join(memories, "id", "left")


def with_records(rows: DataFrame, memories: DataFrame) -> DataFrame:
    """Search rows with their full record (struct, null if it is gone)."""
    kept = [c for c in memories.columns if c != "id"]
    return rows.join(memories.select("id", F.struct(*kept).alias("record")), "id", "left")


def replaced(parents: DataFrame, children: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` in place of those of their id (or added); the children of all parents stay as they are."""
    return parents.join(new.select("id"), "id", "left_anti").unionByName(new.select(*parents.columns)), children


def merge_counts(rows: DataFrame) -> DataFrame:
    """How many rows of each app were merged into another. rows: id, head, app."""
    return rows.where(F.col("head") != F.col("id")).groupBy("app").agg(F.count("*").alias("merged"))


def _since(minutes: int, bounds: tuple[int, int], now_us: Column) -> Column:
    return F.col("us") >= now_us - min(max(minutes, bounds[0]), bounds[1]) * 60_000_000


def recent_changes(df: DataFrame, now_us: Column, minutes: int, newest: int) -> DataFrame:
    """The newest rows of the look back, oldest first, with place."""
    top = df.where(_since(minutes, CHANGES, now_us)).orderBy(F.desc("us"), F.desc("id")).limit(newest)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("us", "id")))


def active_focus(df: DataFrame, now_us: Column, minutes: int) -> DataFrame:
    """The sessions of the newest 30 rows of the look back: rows, apps, first and last time, the newest app."""
    top = df.where(_since(minutes, FOCUS, now_us)).orderBy(F.desc("us"), F.desc("id")).limit(FOCUS_ROWS)
    return top.groupBy("session").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("app")).alias("apps"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("app", F.struct("us", "id")).alias("app"))


def insight_context(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """part (project, edge or conflict), a, b, confidence and place: five best project nodes, three best edges, eight conflicts.

    nodes: id, kind, label, confidence; edges: source, target, edge_type, confidence, conflict. A project
    matches a label that equals it but for case, holds it or is held by it.
    """
    own = nodes.where("kind = 'Project'")
    if project and project.strip():
        p = F.lit(project)
        own = own.where((F.lower("label") == F.lower(p)) | F.col("label").contains(p) | p.contains(F.col("label")))
    row = lambda df, part, a, b: df.select(F.lit(part).alias("part"), a.cast("string").alias("a"), b.cast("string").alias("b"), "confidence")
    best = lambda df, n: df.orderBy(F.desc("confidence"), "a", "b").limit(n)
    clash = edges.where(F.col("conflict") | (F.col("edge_type") == "Contradicts"))
    found = [best(row(own, "project", F.col("id"), F.col("label")), INSIGHT[0]), best(row(edges, "edge", F.col("source"), F.col("target")), INSIGHT[1]), best(row(clash, "conflict", F.col("source"), F.col("target")), INSIGHT[2])]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("confidence"), "a", "b")))


def oldest_first(df: DataFrame) -> DataFrame:
    """All rows from the oldest on, with place; numbered inside days, so no task gets the whole table. df: id, us, day."""
    from .windows import running_total

    return running_total(df, F.lit(1).cast("long"), ["us", "id"], "day", "place").orderBy("us", "id")


def spoken_hits(segments: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Segments that hold a term, by the share of terms they hold, then start and index. segments: meeting, start, index, text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((text.contains(t).cast("int") for t in terms), F.lit(0))
    return segments.withColumn("score", hits / len(terms)).where("score > 0").orderBy(F.desc("score"), "start", "index", "meeting").limit(limit)
