"""Graph operators over nodes (id, ...) and edges (source, target, confidence, edge_type)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .joins import both_ends

LEAST_CONFIDENCE = 0.3

# Names of edge types, their older names, and the kinds of edge.
EDGE_ALIASES = {
    "HasTopic": "MentionedIn", "CausedError": "Causes", "ResolvedError": "Resolves", "MadeDecision": "CreatedBy", "CreatedTodo": "CreatedBy", "RelatedTo": "SimilarTo",
    "Before": "PrecededBy", "After": "FollowedBy", "VisitedUrl": "MentionedIn", "UsesFile": "UsedIn", "MentionsEntity": "MentionedIn",
}
EDGE_TYPES = [
    "DependsOn", "Contains", "Imports", "Extends", "Implements", "PartOf", "Supports", "Contradicts", "Supersedes", "Refines", "Questions", "Resolves", "Causes", "Prevents", "TriggeredBy",
    "FixedBy", "BrokeBy", "PrecededBy", "FollowedBy", "SimilarTo", "MentionedIn", "UsedIn", "CreatedBy", "AppliesTo", "OccurredInSession", "BelongsToProject", "UsedApp", "SameTaskAs", "EvidencedBy",
]
EDGE_KINDS = {
    "structural": ["PartOf", "Contains", "DependsOn", "Imports", "Extends", "Implements", "UsedIn", "CreatedBy", "Refines", "Supports", "FixedBy", "BrokeBy", "Prevents"],
    "semantic": ["SimilarTo"],
    "temporal": ["PrecededBy", "FollowedBy", "Causes", "TriggeredBy"],
    "conflict": ["Contradicts", "Supersedes", "Resolves", "Questions"],
}


def canonical_edges(edges: DataFrame) -> DataFrame:
    """edge_type by its present name; null where the name is unknown."""
    m = F.create_map(*[F.lit(x) for kv in (EDGE_ALIASES | {t: t for t in EDGE_TYPES}).items() for x in kv])
    return edges.withColumn("edge_type", m[F.col("edge_type")])


def edge_kind(edge_type):
    """structural, semantic, temporal, conflict or, for all others, reference."""
    out = F.lit("reference")
    for kind, names in EDGE_KINDS.items():
        out = F.when(edge_type.isin(names), kind).otherwise(out)
    return out


def adjacency(nodes: DataFrame, edges: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(a, b, w) both ways round, for edges of enough confidence whose ends are alive."""
    e = both_ends(edges.where(F.col("confidence") >= least), nodes.select("id"))
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("confidence").alias("w"))
    return e.select(F.explode(F.array(way("source", "target"), way("target", "source"))).alias("e")).select("e.*")


def bfs(adj: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops, path_confidence) of all nodes within ``depth`` hops of the seeds (id): fewest hops, then the best least confidence."""
    seen = seeds.select("id", F.lit(0).alias("hops"), F.lit(1.0).alias("path_confidence")).distinct()
    front = seen
    for h in range(1, depth + 1):
        step = front.join(adj, front.id == adj.a).groupBy(F.col("b").alias("id")).agg(F.max(F.least("path_confidence", "w")).alias("path_confidence"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.lit(h).alias("hops"), "path_confidence"))
        seen = seen.unionByName(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of the seeds and the edges among them."""
    ids = bfs(adjacency(nodes, edges), seeds, min(depth, 3)).select("id")
    return nodes.join(ids, "id", "left_semi"), both_ends(edges, ids)


def shortest_path(adj: DataFrame, source, target, depth: int | None = None) -> DataFrame:
    """(hops, mean_confidence, path) of a fewest-hop path; of equals the best mean confidence, then the least path. No limit of hops unless ``depth`` is given."""
    kind = dict(adj.dtypes)["a"]
    front = cut(adj.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path"), F.lit(0.0).alias("total")))
    seen = front.select("id")
    for h in count(1) if depth is None else range(1, depth + 1):
        step = front.join(adj, front.id == adj.a).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"), (F.col("total") + F.col("w")).alias("total")).join(seen, "id", "left_anti")
        w = Window.partitionBy("id").orderBy(F.desc("total"), "path")
        front = cut(step.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
        hit = front.where(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select(F.lit(h).alias("hops"), F.round(F.col("total") / h, 6).alias("mean_confidence"), "path")
        if front.isEmpty():
            break
        seen = cut(seen.union(front.select("id")))
    return front.where("false").select(F.lit(0).alias("hops"), F.col("total").alias("mean_confidence"), "path")


def pagerank(nodes: DataFrame, adj: DataFrame, rounds: int = 24, d: float = 0.85, cut_every: int = 6) -> DataFrame:
    """r_i = (1-d)/n + d * sum_j w_ij r_j / W_i, with W_i the receiver's own weight sum.

    Nodes whose only neighbour is the same one have the same rank, so the rounds carry
    the least of them, with the sum of their shares; the others get its rank at the end.
    """
    n = max(1, nodes.count())
    base, ids = (1 - d) / n, nodes.select("id")
    pairs = cut(adj.groupBy("a", "b").agg(F.sum("w").alias("w")))
    own = pairs.groupBy("a").agg(F.sum("w").alias("total"), F.count("*").alias("n"), F.min("b").alias("only"))
    own = cut(own.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").withColumn("leaf", F.expr("n = 1 AND total > 0 AND total < double('inf')")).fillna(False, "leaf"))
    leaf = own.where("leaf").select(F.col("a").alias("id"), "only")
    twins = leaf.groupBy("only").agg(F.min("id").alias("twin"))
    names = cut(ids.join(leaf.join(twins, "only").select("id", "twin"), "id", "left").select("id", F.coalesce("twin", "id").alias("twin")))
    live = names.where("id = twin").select("id")
    links = pairs.join(own.where("not leaf").select("a", "total"), "a").select("a", "b", (F.col("w") / F.col("total")).alias("share"))
    links = links.union(twins.select("twin", "only", F.lit(1.0))).join(names.withColumnRenamed("id", "b"), "b")
    links = cut(links.groupBy("a", F.col("twin").alias("b")).agg(F.sum("share").alias("share")))
    r = live.withColumn("r", F.lit(1.0 / n))
    for k in range(rounds):
        got = links.join(r.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), (F.col("share") * F.col("r")).alias("in"))
        r = got.union(live.select("id", F.lit(0.0))).groupBy("id").agg((F.lit(base) + F.lit(d) * F.sum("in")).alias("r"))
        if (k + 1) % cut_every == 0:
            r = cut(r)
    return names.join(r.withColumnRenamed("id", "twin"), "twin", "left").select("id", F.coalesce("r", F.lit(base if rounds else 1.0 / n)).alias("r"))


def components(nodes: DataFrame, adj: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id that a node reaches, by min-label steps with pointer jumping."""
    label = cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        near = adj.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = cut(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("j", "component")).alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        label = new
        if changed:
            return label
    raise RuntimeError("components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, size and importance of each node, from log2(degree + 1)."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
    d = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return d.withColumn("size", F.round(4 + 2 * F.log2(F.col("degree") + 1), 6)).withColumn("importance", F.round(F.least(F.lit(1.0), F.log2(F.col("degree") + 1) / 6), 6))


def bridges(nodes: DataFrame, adj: DataFrame, label: DataFrame, peels: int = 8) -> DataFrame:
    """Cut vertices of components of any size.

    Up to ``peels`` rounds take off the nodes with one neighbour: that neighbour is a
    cut vertex if it has others, and no other node's answer changes. What is left of
    each component is searched in one task, which must hold its edges.
    """
    e = cut(adj.where("a <> b").select("a", "b").distinct())
    found = e.select(F.col("a").alias("id")).where("false")
    for _ in range(peels):
        degree = cut(e.groupBy("a").agg(F.count("*").alias("n")))
        leaf = degree.where("n = 1").select("a")
        if leaf.isEmpty():
            break
        inner = degree.where("n > 1").select(F.col("a").alias("b"))
        found = found.union(e.join(leaf, "a").join(inner, "b").select(F.col("b").alias("id")).distinct())
        e = cut(e.join(leaf, "a", "left_anti").join(leaf.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))
    e = e.join(label.withColumnRenamed("id", "a"), "a").select("component", "a", "b")
    kind = dict(adj.dtypes)["a"]

    def f(pdf):
        import pandas as pd

        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
        order, low, parent, found, clock = {}, {}, {}, set(), 0
        for root in near:
            if root in order:
                continue
            stack, children = [(root, iter(near[root]))], 0
            order[root] = low[root] = clock
            clock += 1
            while stack:
                v, it = stack[-1]
                w = next(it, None)
                if w is None:
                    stack.pop()
                    if stack:
                        p = stack[-1][0]
                        low[p] = min(low[p], low[v])
                        if p != root and low[v] >= order[p]:
                            found.add(p)
                elif w not in order:
                    parent[w] = v
                    children += v == root
                    order[w] = low[w] = clock
                    clock += 1
                    stack.append((w, iter(near[w])))
                elif w != parent.get(v):
                    low[v] = min(low[v], order[w])
            if children > 1:
                found.add(root)
        return pd.DataFrame({"id": sorted(found)})

    return found.union(e.groupBy("component").applyInPandas(f, f"id {kind}")).distinct()


def communities(nodes: DataFrame) -> DataFrame:
    """Derived communities: the first of project, topic, kind that is filled; count and mean importance, largest first."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("project", "topic", "kind")])
    return nodes.groupBy(key.alias("community")).agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


def stale(nodes: DataFrame, days, limit: int = 30) -> DataFrame:
    return nodes.withColumn("stale", days > limit)


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes and the edges that touch them."""
    n = nodes.join(gone, "id", "left_anti")
    return n, edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")


def anchors(df: DataFrame, index: str, total: int) -> DataFrame:
    """Points spread evenly on a sphere, by index."""
    y = 1 - 2 * (F.col(index) + 0.5) / max(1, total)
    r, t = F.sqrt(1 - y * y), F.col(index) * 2.399963229728653
    return df.withColumns({"x": F.round(r * F.cos(t), 6), "y": F.round(y, 6), "z": F.round(r * F.sin(t), 6)})


def ingest(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (memory, session, app) and edges of observations."""
    node = lambda kind, c: memories.select(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("label"))
    nodes = node("memory", "id").union(node("session", "session").distinct()).union(node("app", "app").distinct())
    edge = lambda to, c, kind: memories.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("source"), F.concat(F.lit(f"{to}:"), F.col(c)).alias("target"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("confidence"))
    return nodes, edge("session", "session", "part_of").union(edge("app", "app", "visited"))
