"""Context products: knowledge pages, evidence, tasks, cards, answers, suggestions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..session import ship
from .retrieval import Profile, coverage, mentions, phrase_alignment


def inverted_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """value -> ordered distinct ids, for a list column."""
    x = df.select("id", F.explode(column).alias("value")).where(F.trim("value") != "")
    return x.groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.lit(name).alias("kind"), "value", "ids")


def evidence_pack(df: DataFrame, columns: list[str]) -> DataFrame:
    """One inverted index for each list column, in one table."""
    out = None
    for c in columns:
        one = inverted_index(df, c, c)
        out = one if out is None else out.unionByName(one)
    return out


def knowledge_pages(df: DataFrame, kind: str, key: Column, least: int = 1, newest: int = 240) -> DataFrame:
    """Pages of one kind: key, first and last time, number of supporting rows, mean confidence, stability (stable from four on)."""
    g = df.withColumn("key", key).where("key is not null and trim(key) <> ''").groupBy("key")
    pages = g.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("support"), F.round(F.avg("confidence"), 6).alias("confidence"))
    pages = pages.where(F.col("support") >= least).withColumn("stability", F.when(F.col("support") >= 4, "stable").otherwise("emerging"))
    return pages.withColumn("kind", F.lit(kind)).orderBy(F.desc("last_us"), "key").limit(newest)


def claim_key(text: Column) -> Column:
    """First sentence as a key of words joined by ':', for sentences of at least four words."""
    w = X.words(F.regexp_extract(text, "^([^.!?\\n]+)", 1))
    return F.when(F.size(w) >= 4, F.array_join(F.slice(w, 1, 12), ":"))


def related_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, related): parent, related and merged ids of each row, each once."""
    return df.select("id", F.explode(F.array_distinct(F.array_compact(F.flatten(F.array(*[F.col(c) for c in columns]))))).alias("related")).where("id <> related")


def linked_tasks(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with an event of their project among their source and linked ids. tasks: id, project, source, linked."""
    x = tasks.select("id", "project", F.explode(F.array_distinct(F.concat(F.array("source"), F.coalesce("linked", F.array().cast(dict(tasks.dtypes)["linked"]))))).alias("memory"))
    hit = x.join(events.select(F.col("id").alias("memory"), "project").distinct(), ["memory", "project"], "left_semi").select("id").distinct()
    return tasks.join(hit, "id", "left_semi")


def pruned_tasks(tasks: DataFrame, live: DataFrame) -> DataFrame:
    """Tasks whose source is gone become dismissed."""
    ok = live.select(F.col("id").alias("source")).distinct().withColumn("_live", F.lit(True))
    return tasks.join(ok, "source", "left").withColumn("status", F.when(F.col("_live").isNull(), "dismissed").otherwise(F.col("status"))).drop("_live")


def auto_cluster(neighbours: DataFrame, tasks: DataFrame, least: float = 0.82) -> DataFrame:
    """id, action, task: join the task of the most similar neighbour that has one; seed a task with two or more peers; else none.

    neighbours: id, peer, similarity; tasks: peer, task.
    """
    near = neighbours.where(F.col("similarity") >= least).join(tasks, "peer", "left")
    g = near.groupBy("id").agg(F.count("*").alias("peers"), F.max_by("task", F.when(F.col("task").isNotNull(), F.struct("similarity", "task"))).alias("task"))
    return g.select("id", F.when(F.col("task").isNotNull(), "join").when(F.col("peers") >= 2, "seed").otherwise("none").alias("action"), "task", "peers")


#: Far above what the order of summing changes in a cosine, far under what tells two vectors apart.
MARGIN = 1e-9


def _matrix(t: pa.Table, dim: int):
    """(ids, vectors, which vectors have an absent component)."""
    if not dim or not t.num_rows:
        return t.column("id").to_numpy(), np.zeros((t.num_rows, dim)), np.zeros(t.num_rows, bool)
    flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks] or [pa.array([], pa.float64())])
    absent = flat.is_null().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim).any(1)
    return t.column("id").to_numpy(), flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(t.num_rows, dim), absent


def _cosines(q, x, q_absent, x_absent):
    """Cosines as they rank, and where no rounding is in them: no number (first), 0 for a zero norm, absent (last)."""
    with np.errstate(all="ignore"):
        both = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        s = (q @ x.T) / both
    s[~np.isfinite(s)] = np.inf
    s[both == 0] = 0.0
    if q.shape[1]:
        s[q_absent[:, None] | x_absent[None, :]] = -np.inf
    return s, (both == 0) | ~np.isfinite(s)


def _candidates(k: int):
    """Of one block of rows and one of queries: each query's rows that may be among its k most similar."""

    def f(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids, x, absent = _matrix(rows.sort_by("id"), dim)
        own, q, q_absent = _matrix(queries, dim)
        # of equal vectors only the k + 1 smallest ids can count (one may be the query's own)
        parts = np.ascontiguousarray(np.column_stack([x, absent]))
        same = np.unique(parts.view(np.dtype((np.void, parts.dtype.itemsize * (dim + 1)))).ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(same[order]) != 0) | (np.diff(ids[order]) != 0)
        order = order[new]
        starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0]) if len(order) else order
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        keep = np.sort(order[place <= k])
        ids, x, absent = ids[keep], x[keep], absent[keep]
        out = []
        for at in range(0, len(q) if len(x) else 0, 512):
            s, even = _cosines(q[at : at + 512], x, q_absent[at : at + 512], absent)
            s[own[at : at + 512, None] == ids[None, :]] = np.nan
            for i, row in enumerate(s):
                there = np.flatnonzero(~np.isnan(row))
                if len(there) > k:
                    least = np.partition(row[there], len(there) - k)[len(there) - k]
                    there = there[row[there] >= least - MARGIN]
                for v in np.unique(row[there][even[i, there]]) if len(there) > k else ():  # these rank by id
                    tied = there[even[i, there] & (row[there] == v)]
                    there = np.setdiff1d(there, tied[k:], assume_unique=True)
                out.append((np.full(len(there), own[at + i]), ids[there], row[there]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64()])], ["qid", "peer", "near"])

    return f


def nearest(df: DataFrame, queries: DataFrame, k: int, block: int = 4096, chunk: int = 8192) -> DataFrame:
    """(id, peer, similarity, rank): the k rows most similar (cosine) to each row of a stated query set.

    Blocks of rows meet blocks of queries of their length as matrices, which gives
    each query's candidates; those within ``MARGIN`` of the k-th are scored again by
    the cosine of this library, so ranks and ties are those of the plain join. ids: long.
    """
    held = lambda d: d.where("id is not null").select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim")).where("v is not null")
    ship(df.sparkSession)
    n, m = df.count(), queries.count()
    blocks, chunks = max(1, min(128, -(-n // block)), -(-n // 65536)), max(1, -(-m // chunk))  # beyond 128 blocks these grow first
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x, q = held(df), held(queries)
    tasks = min(blocks * chunks, 4096)
    x = x.withColumns({"b": deal(blocks), "c": spread(chunks)}).repartition(tasks, "dim", "b", "c")
    q = q.withColumns({"b": spread(blocks), "c": deal(chunks)}).repartition(tasks, "dim", "b", "c")
    found = x.groupBy("dim", "b", "c").cogroup(q.groupBy("dim", "b", "c")).applyInArrow(_candidates(k), "qid long, peer long, near double")
    order = Window.partitionBy("qid").orderBy(F.desc("near"))
    found = found.withColumn("r", F.row_number().over(order)).withColumn("least", F.min(F.when(F.col("r") <= k, F.col("near"))).over(Window.partitionBy("qid")))
    found = found.where(F.col("near") >= F.col("least") - MARGIN).select("qid", "peer").distinct()
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "peer")
    met = found.join(queries.select(F.col("id").alias("qid"), F.col("embedding").alias("q")), "qid").join(df.withColumnRenamed("id", "peer"), "peer").where(F.size("embedding") == F.size("q"))
    pairs = met.select(F.col("qid").alias("id"), "peer", V.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suggestion(near: DataFrame, recent: DataFrame, least: float = 0.82) -> DataFrame:
    """The most similar row over the threshold that was not suggested lately."""
    return near.where(F.col("similarity") > least).join(recent.select(F.col("id").alias("peer")), "peer", "left_anti").orderBy(F.desc("similarity"), "peer").limit(1)


def coverage_rerank(pool: DataFrame, p: Profile) -> DataFrame:
    """Drop rows of anchor coverage under .15; .7 score + .3 coverage, +.12 for the exact phrase."""
    c = coverage(p, F.col("toks"))
    phrase = F.when(F.col("norm").contains(p.normalised), 0.12).otherwise(0.0)
    return pool.where(c >= 0.15).withColumn("score", 0.7 * F.col("score") + 0.3 * c + phrase)


def transcript_match(p: Profile, norm: Column, tokens: Column) -> Column:
    return F.when(norm.contains(p.normalised), 1.0).otherwise(coverage(p, tokens))


def grounding(p: Profile, answer_tokens: Column, evidence_tokens: Column, top: Column) -> Column:
    """.45 answer words in the evidence + .35 query coverage + .20 best score."""
    share = F.size(F.array_intersect(answer_tokens, evidence_tokens)) / F.greatest(F.size(answer_tokens), F.lit(1))
    return 0.45 * share + 0.35 * coverage(p, evidence_tokens) + 0.20 * F.least(top, F.lit(1.0))


def autofill(candidates: DataFrame) -> DataFrame:
    """Best candidate of each value: .28 search + .28 extraction + .20 context + .10 confidence + .08 document + .06 recency - .08 noise; over .72 it needs no confirmation."""
    s = 0.28 * F.col("search") + 0.28 * F.col("extraction") + 0.20 * F.col("context") + 0.10 * F.col("confidence") + 0.08 * F.col("document") + 0.06 * F.col("recency") - 0.08 * F.col("noise")
    best = candidates.withColumn("score", s).groupBy("value").agg(F.max("score").alias("score"))
    return best.withColumn("confirm", F.col("score") < 0.72).orderBy(F.desc("score"), "value")


def ui_relevance(p: Profile, title: Column, summary: Column, project: Column) -> Column:
    """.8 title, .5 summary, .3 project, at most 1."""
    has = lambda c: F.greatest(*[F.lower(F.coalesce(c, F.lit(""))).contains(t).cast("int") for t in p.primary], F.lit(0))
    return F.least(F.lit(1.0), 0.8 * has(title) + 0.5 * has(summary) + 0.3 * has(project))


def surfacing_reason(routes: Column, phrase: Column, cover: Column) -> Column:
    return F.concat(F.when(phrase >= 1, "Exact phrase").when(cover >= 0.5, "Most query words").when(cover > 0, "Some query words").otherwise("Similar meaning"), F.lit("; via "), routes)


def explanation(p: Profile, summary: Column, age_hours: Column) -> Column:
    """Query terms that the summary holds and a coarse age."""
    w = X.words(summary)
    terms = F.filter(F.array(*[F.lit(t) for t in p.primary]).cast("array<string>"), lambda t: F.array_contains(w, t))
    age = F.when(age_hours < 1, "just now").when(age_hours < 24, "today").when(age_hours < 168, "this week").otherwise("earlier")
    return F.concat_ws("; ", F.array_join(terms, ", "), age)


def cards(df: DataFrame, group: str, score: str, most: int = 12) -> DataFrame:
    """Cards of groups: rank-weighted score, span in minutes, first text, members."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "id")
    r = df.withColumn("_r", F.row_number().over(w))
    v = F.least(F.lit(1.0), F.sum(F.col(score) / F.col("_r")) / F.sum(1 / F.col("_r")) + 0.04 * F.count("*"))
    g = r.groupBy(group).agg(F.round(v, 6).alias("card_score"), F.round((F.max("us") - F.min("us")) / 6e7, 6).alias("minutes"), F.min_by("title", "_r").alias("title"), F.count("*").alias("n"))
    return g.orderBy(F.desc("card_score"), group).limit(most)


def errors(df: DataFrame, since_us: int, limit: int) -> DataFrame:
    """Newest error mentions in the window, each once. df: id, us, errors (list)."""
    x = df.where(F.col("us") >= since_us).select("id", "us", F.explode("errors").alias("error")).where(F.trim("error") != "")
    w = Window.partitionBy("error").orderBy(F.desc("us"), "id")
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("us"), "id").limit(limit)


def open_tasks(tasks: DataFrame, project: str, cap: int = 8) -> DataFrame:
    return tasks.where((F.col("status") == "open") & (F.lower("project") == project.lower())).orderBy("title", "id").limit(cap)


def source_evidence(pages: DataFrame, memories: DataFrame) -> DataFrame:
    """Supporting ids of pages with their rows; missing rows stay, without content."""
    return pages.select(F.col("id").alias("page"), F.explode("support").alias("id")).join(memories, "id", "left")


def entity_nodes(df: DataFrame, text: str, most: int = 8) -> DataFrame:
    """id, kind, label, confidence of at most ``most`` entities of each row, by kind and first place."""
    m = X.mentions(F.col(text))
    kinds = (("file", m["files"], 0.9), ("url", m["urls"], 0.85), ("issue", m["issues"], 0.8), ("command", m["commands"], 0.7))
    found = F.concat(*[F.transform(c, _node(k, w)) for k, c, w in kinds])
    return df.select("id", F.explode(F.slice(found, 1, most)).alias("n")).select("id", "n.*")


def _node(kind: str, weight: float):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label"), F.lit(weight).alias("confidence"))


def node_text_search(nodes: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return nodes.where(F.lower(F.col("label")).contains(q) | F.lower(F.col("id").cast("string")).contains(q))


def working_state(df: DataFrame, now_us: int) -> DataFrame:
    """One row: last app and project, minutes since, rows of the last hour, whether idle (over 30 minutes)."""
    last = F.max_by(F.struct("app", "project"), F.struct("us", "id"))
    idle = (F.lit(now_us) - F.max("us")) / 6e7
    return df.agg(last["app"].alias("app"), last["project"].alias("project"), F.round(idle, 3).alias("idle_minutes"), F.count_if(F.col("us") >= now_us - 3_600_000_000).alias("last_hour"), (idle > 30).alias("idle"))


def compose_answer(evidence: DataFrame, cap: int = 5) -> DataFrame:
    """One row: an answer of cited snippets, best first, and whether every citation is among the evidence."""
    top = evidence.orderBy(F.desc("score"), "id").limit(cap)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "snippet"))), lambda r: F.concat(F.lit("["), r["id"].cast("string"), F.lit("] "), r["snippet"])), "\n")
    return top.agg(lines.alias("answer"), F.count("*").alias("citations"), (F.count("*") > 0).alias("valid"))


def citations_valid(answer: Column, ids: Column) -> Column:
    cited = F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"))
    return F.forall(cited, lambda c: F.array_contains(F.transform(ids, lambda i: i.cast("string")), c))


def key_values(changes: DataFrame) -> DataFrame:
    """Keyed state: the last payload of each key; a null payload deletes it. changes: key, payload, us."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("payload", "us"), F.struct("us", F.col("payload"))).alias("r"))
    return last.where("r.payload is not null").select("key", "r.payload", F.col("r.us").alias("us"))


def open_issues(events: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` issues that events name, each as its first event has it. events: us, id, summary, outcome, entities of (kind, key, name)."""
    named = events.select("us", "id", "summary", "outcome", F.posexplode("entities").alias("at", "e")).where("e.kind = 'issue'")
    status = F.when(F.col("outcome") == "succeeded", "resolved").otherwise("open")
    rows = named.select("us", "id", "at", F.col("e.key").alias("issue"), F.col("e.name").alias("title"), X.trim_to(F.col("summary"), 140).alias("summary"), status.alias("status"))
    first = rows.groupBy("issue").agg(F.min_by(F.struct("us", "id", "at", "title", "summary", "status"), F.struct("us", "id", "at")).alias("r"))
    return first.orderBy("r.us", "r.id", "r.at").limit(limit).select("issue", "r.title", "r.summary", "r.status")
