"""Graphs out of records and activities, kept up by deltas.

``memory_graph`` and ``activity_graph`` make nodes (id, kind, label, confidence or
created) and edges of each row in one pass over its own fields. ``graph_sink``
writes a micro-batch's nodes and edges, added up by their identity, as the delta of
that batch, so a replay writes the same files; ``graph_now`` folds the deltas into
the graph as it stands, ``compacted`` folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Lengths of labels, nodes of a record, the least confidence of an edge, labels that say nothing.
LABEL, MOST_NODES, LEAST_EDGE = (3, 80), 8, 0.4
NO_LABELS = "the and for with from this that unknown none n/a untitled page window document loading error home search".split()
# A node's share of the record's confidence and its least confidence.
NODE_SHARES = {
    "memory": (0.95, 0.45), "project": (1.0, 0.45), "topic": (0.95, 0.35), "url": (0.9, 0.4), "file": (0.85, 0.35), "decision": (0.92, 0.42), "error": (0.8, 0.4), "tool": (0.78, 0.35), "session": (0.5, 0.3),
    "happened": (0.9, 0.36), "mattered": (0.85, 0.36), "changed": (0.75, 0.36),
}
# An edge's share of the record's confidence.
EDGE_SHARES = {"project_session": 0.78, "session_memory": 0.82, "belongs": 0.82, "occurred": 0.82, "mentioned": 0.70, "applies": 0.72, "contradicts": 0.65, "questions": 0.55, "similar": 0.66, "followed": 0.64}
# Node kinds and edge types of an activity's entities, and names that are too general.
ENTITY_KINDS = {"file": "File", "url": "Url", "error": "Error", "command": "Command", "decision": "Decision", "issue": "Issue", "concept": "Concept", "project": "Project"}
ENTITY_EDGES = {"file": "EditedFile", "error": "BlockedBy", "command": "InformedBy", "decision": "ResultedIn"}
PARTS = ("nodes", "edges")
GENERAL, SURE, TITLE = ["ui", "window", "chrome", "browser", "tab", "page"], 0.70, 120


def _label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))


def _says_something(label: Column) -> Column:
    return F.length(_label(label)).between(*LABEL) & ~F.lower(_label(label)).isin(NO_LABELS)


def _is_plain(label: Column) -> Column:
    """``_says_something`` of what ``_label`` gave."""
    return F.length(label).between(*LABEL) & ~F.lower(label).isin(NO_LABELS)


def _node(kind: str, label: Column, base: Column, share: str) -> Column:
    of, least = NODE_SHARES[share]
    confidence = F.least(F.lit(1.0), F.greatest(base * of, F.lit(least)))
    return F.struct(F.concat(F.lit(kind + "|"), F.lower(label)).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), confidence.alias("confidence"))


def memory_graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with memory, edges with confidence and conflict) of records.

    df: id, session, project, topic, url, files, decisions, errors, tools, happened,
    mattered, changed, insight, confidence, related, context. A record has at most
    eight nodes, itself included, in this order of fields; a label twice of one kind
    counts once. Edges under 0.4 are left out.
    """
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.greatest("insight", F.lit(0.0)), F.lit(1.0)) * 0.55 + F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * 0.45))
    rows = df.withColumn("base", base).withColumn("me", F.concat(F.lit("Memory|"), F.col("id").cast("string")))
    b = F.col("base")
    known = lambda c: (F.trim(F.col(c)) != "") & (F.col(c) != "unknown")
    none = F.array().cast("array<string>")
    nodes_of = lambda labels, kind, share, says: F.transform(F.filter(labels, says), lambda x: _node(kind, x, b, share))  # a label is made once
    one = lambda when, kind, label, share, says=_is_plain: nodes_of(F.when(F.coalesce(when, F.lit(False)), F.array(label)).otherwise(none), kind, share, says)
    some = lambda c, most, kind, share, shape: nodes_of(F.transform(F.slice(F.coalesce(F.col(c), none), 1, most), shape), kind, share, _is_plain)
    leaf = lambda p: _label(F.coalesce(F.nullif(F.regexp_extract(p, "([^/]+)/*$", 1), F.lit("")), p))
    url = F.substring(F.coalesce(F.get(F.split("url", "//"), F.lit(1)), F.col("url")), 1, LABEL[1])
    found = F.concat(
        one(known("project"), "Project", _label(F.col("project")), "project"),
        one(known("topic"), "Concept", _label(F.col("topic")), "topic"),
        one(F.trim("url") != "", "Url", url, "url", _says_something),
        some("files", 3, "File", "file", leaf),
        some("decisions", 2, "Decision", "decision", _label),
        some("errors", 2, "Error", "error", _label),
        some("tools", 2, "Tool", "tool", _label),
        one(F.lit(True), "Session", F.concat(F.lit("session "), F.substring(F.coalesce("session", F.lit("")), 1, 12)), "session", _says_something),
        *[one(F.lit(True), "Concept", _label(F.col(c)), c) for c in ("happened", "mattered", "changed")],
    )
    ids = lambda v: F.transform(v, lambda n: n["id"])
    rows = rows.withColumn("found", found)
    rows = rows.withColumn("nodes", F.slice(F.filter("found", lambda n, i: F.array_position(ids(F.col("found")), n["id"]) == i + 1), 1, MOST_NODES - 1))
    me = F.struct(F.col("me").alias("id"), F.lit("Memory").alias("kind"), F.concat(F.lit("Memory "), F.substring(F.col("id").cast("string"), 1, 10)).alias("label"), F.least(F.lit(1.0), F.greatest(b * NODE_SHARES["memory"][0], F.lit(NODE_SHARES["memory"][1]))).alias("confidence"))
    nodes = rows.select(F.col("id").alias("memory"), F.explode(F.concat(F.array(me), "nodes")).alias("n")).select("memory", "n.*")

    first = lambda kind: F.get(F.filter("nodes", lambda n: n["kind"] == kind), F.lit(0))["id"]
    edge = lambda a, z, kind, share, conflict=False: F.struct(a.alias("source"), z.alias("target"), F.lit(kind).alias("edge_type"), (b * EDGE_SHARES[share]).alias("confidence"), F.lit(conflict).alias("conflict"))
    m, p, s, d, e = F.col("me"), first("Project"), first("Session"), first("Decision"), first("Error")
    both = [edge(p, s, "Contains", "project_session"), F.when(p.isNotNull(), edge(s, m, "Contains", "session_memory")), edge(m, p, "BelongsToProject", "belongs"), F.when(F.trim("session") != "", edge(m, s, "OccurredInSession", "occurred"))]
    both += [edge(p, first("Url"), "AppliesTo", "applies"), edge(d, e, "Contradicts", "contradicts", True), edge(d, e, "Questions", "questions", True)]
    others = F.transform(F.filter("nodes", lambda n: ~n["kind"].isin("Project", "Session")), lambda n: edge(m, n["id"], "MentionedIn", "mentioned"))
    near = F.transform(F.filter(F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: (r != "") & (r != F.col("id").cast("string"))), lambda r: edge(m, F.concat(F.lit("Memory|"), r), "SimilarTo", "similar"))
    prior = F.regexp_extract(F.coalesce("context", F.lit("")), "(?m)^[^\\S\\n]*Continues from ([^:\\s]+)", 1)
    after = F.when((prior != "") & (prior != F.col("id").cast("string")), edge(F.concat(F.lit("Memory|"), prior), m, "FollowedBy", "followed"))
    edges = rows.select(F.explode(F.concat(F.array(*both, after), others, near)).alias("e")).where("e is not null").select("e.*")
    return nodes, edges.where((F.col("confidence") >= LEAST_EDGE) & F.col("source").isNotNull() & F.col("target").isNotNull())


def activity_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, label, us; edges: source, target, edge_type, us) of activities.

    events: id, title, us, memory, project, entities (array of id, name, kind,
    confidence), evidence (array of id, source_id, summary, snippet, us), errors,
    todos. A too general entity of under 0.7 is left out; blank errors and todos are none.
    """
    me = F.concat(F.lit("activity:"), F.col("id").cast("string"))

    def item(part, a, b=None, kind=None, confidence=None, at=None):
        """Fields as they are; rules and keys are worked out when each item stands in a row."""
        values = (F.lit(part), a, b, kind, confidence, at)
        return F.struct(*[(F.lit(None) if v is None else v).cast(t).alias(c) for v, t, c in zip(values, ("string", "string", "string", "string", "double", "long"), ("part", "a", "b", "kind", "confidence", "at"))])

    def exploded(*more):
        items = [
            F.array(*more, item("project", F.col("project"))),
            F.transform("entities", lambda x: item("entity", x["id"], x["name"], x["kind"], x["confidence"])),
            F.transform("evidence", lambda x: item("evidence", x["id"], x["source_id"], F.when(F.trim(F.coalesce(x["summary"], F.lit(""))) != "", x["summary"]).otherwise(x["snippet"]), None, x["us"])),
            F.transform("errors", lambda x: item("blocker", x)),
            F.transform("todos", lambda x: item("todo", x)),
        ]
        rows = events.select("id", "title", "us", F.explode(F.concat(*items)).alias("x")).select("id", "title", "us", "x.*")
        too_general = (F.col("confidence") < SURE) & X.alias_key(F.col("b")).isin(GENERAL)
        return rows.where(F.when(part("entity"), ~too_general).when(part("blocker") | part("todo"), F.trim("a") != "").when(part("project"), F.col("a").isNotNull()).otherwise(True))

    part = lambda name: F.col("part") == name
    mapped = lambda table, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("kind")], F.lit(other))
    proof = F.when(F.trim(F.coalesce("a", F.lit(""))) == "", F.concat(F.lit("evidence:"), F.col("id").cast("string"), F.lit(":"), X.alias_key(F.col("b")))).otherwise(F.col("a"))
    keyed = F.concat("part", F.lit(":"), X.alias_key(F.col("a")))
    own = F.when(part("self") | part("entity"), F.col("a")).when(part("evidence"), proof)
    kind = F.when(part("self"), "ActivityEvent").when(part("project"), "Project").when(part("entity"), mapped(ENTITY_KINDS, "Entity")).when(part("evidence"), "Entity").when(part("blocker"), "Error").otherwise("Task")
    label = F.when(part("self"), F.col("title")).when(part("project"), F.col("a")).when(part("entity"), F.col("b")).when(part("evidence"), X.trim_to(F.col("kind"), TITLE)).otherwise(X.trim_to(F.col("a"), TITLE))
    nodes = exploded(item("self", me)).select(own.otherwise(keyed).alias("id"), kind.alias("kind"), label.alias("label"), F.when(part("evidence"), F.col("at")).otherwise(F.col("us")).alias("us"))
    target = own.when(part("memory"), F.concat(F.lit("memory:"), "a")).otherwise(keyed)
    edge = F.when(part("project"), "BelongsTo").when(part("entity"), mapped(ENTITY_EDGES, "MentionedIn")).when(part("evidence"), "InformedBy").when(part("blocker"), "BlockedBy").otherwise("ResultedIn")
    edges = exploded(item("memory", F.col("memory"))).select(me.alias("source"), target.alias("target"), edge.alias("edge_type"), "us")
    return nodes, edges


def _nodes(df: DataFrame) -> DataFrame:
    """One row for each node: the newest (then greatest) kind and label, first and last time, how often it was put in."""
    last = F.max(F.struct("last_us", "kind", "label"))
    return df.groupBy("id").agg(F.min("first_us").alias("first_us"), last.alias("m"), F.sum("n").alias("n")).select("id", "m.kind", "m.label", "first_us", "m.last_us", "n")


def _edges(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "target", "edge_type").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"))


def merged_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by (source, target, edge_type), with the number of rows that tell of them (n)."""
    once = {"first_us": F.col("us"), "last_us": F.col("us"), "n": F.lit(1).cast("long")}
    return _nodes(nodes.withColumns(once)), _edges(edges.withColumns(once))


def graph_sink(path: str, parts: tuple[str, ...] = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for activities: batch k's delta replaces nodes/batch=k and edges/batch=k; of ``parts`` alone, where only one of them is kept."""

    def write(batch: DataFrame, no: int) -> None:
        for name, df in zip(PARTS, merged_graph(*activity_graph(batch))):
            if name in parts:
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={no}")

    return write


def graph_now(spark: SparkSession, path: str, parts: tuple[str, ...] = PARTS) -> tuple[DataFrame, ...]:
    """The graph out of all deltas."""
    folds = dict(zip(PARTS, (_nodes, _edges)))
    return tuple(folds[name](spark.read.parquet(f"{path}/{name}")) for name in parts)


def compacted(spark: SparkSession, path: str, to: str, parts: tuple[str, ...] = PARTS) -> None:
    """Fold the deltas under ``path`` into one under ``to``; later batches go there under their own numbers."""
    for name, df in zip(parts, graph_now(spark, path, parts)):
        df.write.mode("overwrite").parquet(f"{to}/{name}/batch=-1")
