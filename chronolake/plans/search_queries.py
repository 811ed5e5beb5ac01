"""Vector, lexical, retrieval and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import time as T
from ..functions import vector as V
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import stats
from ..sources.memory import MEMORIES as M
from ..sources.memory import latest, memories, table
from .registry import query

QUERY_VECTOR = [round(0.2 - 0.4 * ((7 * i) % 13) / 12, 6) for i in range(64)]
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_D2 = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_QV}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_SIM = "CASE WHEN d <= 4 THEN greatest(0, least(1, 1 - d / 2)) ELSE 1 / (1 + d) END"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("v01_knn", f"WITH x AS (SELECT vec_id AS id, {_D2} AS d FROM embeddings) SELECT id, round(d, 6) AS distance, round({_SIM}, 6) AS score FROM x ORDER BY d, id LIMIT 20")
def _(spark, d):
    return R.knn(vectors(spark, d), "embedding", QUERY_VECTOR, 20).select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("v01_knn_filtered", f"WITH x AS (SELECT vec_id AS id, {_D2} AS d FROM embeddings WHERE label = 3) SELECT id, round(d, 6) AS distance FROM x ORDER BY d, id LIMIT 10")
def _(spark, d):
    return R.knn(vectors(spark, d), "embedding", QUERY_VECTOR, 10, F.col("label") == 3).select("id", F.round("distance", 6).alias("distance"))


@query("v04_similar_to", "WITH s AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), x AS (SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, s WHERE vec_id <> 7) SELECT id, round(d, 6) AS distance FROM x ORDER BY d, id LIMIT 10")
def _(spark, d):
    return R.similar_to(vectors(spark, d), "embedding", 7, 10).select("id", F.round("distance", 6).alias("distance"))


@query("v07_cosine", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS cosine FROM embeddings")
def _(spark, d):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return vectors(spark, d).select("id", F.round(V.cosine(F.col("embedding"), q), 6).alias("cosine"))


@query("v09_blend", f"WITH b AS (SELECT vec_id AS id, list_transform(list_zip(embedding::DOUBLE[], {_QV}), lambda z: 0.62 * z[1] + 0.38 * z[2]) AS v FROM embeddings) SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM b")
def _(spark, d):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return vectors(spark, d).select("id", F.round(V.blend([(F.col("embedding"), 0.62), (q, 0.38)])[0], 6).alias("first"))


@query("v10_mean_pool", "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, round(x / n, 6) AS first FROM m JOIN n USING (label) WHERE i = 1")
def _(spark, d):
    e = vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"), F.max(F.when(F.col("i") == 0, F.col("x"))).alias("x0"))
    return n.select("label", F.round(F.col("x0") / F.col("n"), 6).alias("first"))


@query("v12_low_signal", "SELECT vec_id AS id, vec_id % 5 < 3 AS low FROM embeddings")
def _(spark, d):
    id, e = F.col("id"), F.col("embedding").cast("array<double>")
    odd = F.when(id % 5 == 0, F.transform(e, lambda x: x * 1e-9)).when(id % 5 == 1, F.array_append(e, F.lit(float("nan")))).when(id % 5 == 2, F.slice(e, 1, 0)).otherwise(e)
    return vectors(spark, d).select("id", V.low_signal(odd).alias("low"))


@query("v11_fitted", "SELECT vec_id AS id, CASE WHEN len(embedding) = 64 THEN 64 ELSE 32 END AS n FROM embeddings")
def _(spark, d):
    return vectors(spark, d).select("id", F.size(V.fitted(F.col("embedding"), 64)).alias("n"))


@query("v05_chunk_parents", f"WITH x AS (SELECT vec_id AS id, vec_id % 50 AS parent, {_D2} AS d FROM embeddings), b AS (SELECT *, {_SIM} AS s FROM x QUALIFY row_number() OVER (PARTITION BY parent ORDER BY {_SIM} DESC, d, id) = 1) SELECT parent, b.id AS chunk, round(s, 6) AS score FROM b JOIN documents ON doc_id = parent ORDER BY s DESC, d, parent LIMIT 20")
def _(spark, d):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    c = vectors(spark, d).withColumn("parent", F.col("id") % 50).withColumn("distance", V.squared_distance(F.col("embedding"), q)).withColumn("score", V.similarity(F.col("distance")))
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return R.chunk_hits(c, parents, 20).select("parent", "chunk", F.round("score", 6).alias("score"))


@query("v14_provenance", "SELECT vec_id AS id, round(0.8::DOUBLE * CASE label % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 WHEN 2 THEN 0.74 WHEN 3 THEN 0.5 ELSE 0.45 END, 6) AS score FROM embeddings")
def _(spark, d):
    states = F.array(*[F.lit(k) for k in V.PROVENANCE])
    x = vectors(spark, d).withColumn("state", F.element_at(states, (F.col("label") % 6 + 1).cast("int"))).withColumn("score", F.lit(0.8))
    return R.provenance(x, "state", "score").select("id", F.round("score", 6).alias("score"))


SEARCH = "The heatou ononat shheed eronnten"


@query("l02_lexical_score", """WITH t AS (SELECT unnest(['thnt', 'erly', 'ononat']) AS t), x AS (SELECT doc_id AS id, lower(text) AS a, lower(source) AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT id, CASE WHEN contains(a, t) THEN 1.1 ELSE 0 END + CASE WHEN contains(b, t) THEN 0.75 ELSE 0 END AS w FROM x, t)
SELECT id, round(0.7 * least(1, sum(w) / (2.8 * 3)) + 0.3 * sum(CASE WHEN w > 0 THEN 1.0 ELSE 0 END) / 3, 6) AS score FROM p GROUP BY id""")
def _(spark, d):
    s = R.lexical_score({"text": F.col("text"), "app": F.col("source")}, ["thnt", "erly", "ononat"])
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.round(s, 6).alias("score"))


_TERMS = ["heatou", "ononat", "shheed", "eronnten"]
_FOUND = " OR ".join(f"contains(lower(text), '{t}')" for t in _TERMS)
_W = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1.1 ELSE 0 END" for t in _TERMS)
_C = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1.0 ELSE 0 END" for t in _TERMS)


@query("l04_keyword_search", f"SELECT doc_id AS id, round(0.86 * (0.7 * least(1, ({_W} + CASE WHEN contains(lower(text), '{SEARCH.lower()}') THEN 1.1 ELSE 0 END) / (2.8 * 4)) + 0.3 * ({_C}) / 4) + 0.14 * 0.5, 6) AS score FROM documents WHERE {_FOUND} ORDER BY score DESC, id LIMIT 20")
def _(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return R.keyword_search(docs, SEARCH, {"text": "text"}, F.lit(0.5), 20).select("id", F.round("score", 6).alias("score"))


@query("l11_bm25")
def _(spark, d):
    p = R.Profile(SEARCH)
    docs = R.with_text(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    return R.bm25(docs, p).where("bm25 > 0").select("id", F.round("bm25", 6).alias("score"))


@query("l13_phrase_alignment")
def _(spark, d):
    p = R.Profile(SEARCH)
    docs = R.with_text(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    found = F.struct(F.round(R.phrase_alignment(p, F.col("norm")), 6).alias("phrase"), F.round(R.text_coverage(p, F.col("norm")), 6).alias("coverage"))
    return R.once(docs.select("id", "norm"), "found", found).select("id", "found.*").where("phrase > 0 OR coverage > 0")


@query("l19_signal_strength", "SELECT doc_id AS id, round(0.24 * 0.9 + 0.28 * (1 - least(n_chars / 100000, 1)) + 0.18 * CASE lang WHEN 'llm' THEN 1 ELSE 0.58 END + 0.16 * least(len(list_filter(string_split(trim(regexp_replace(lower(substr(text, 1, 80)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')), 24) / 24 + 0.14 * least(n_chars // 6, 80) / 80, 6) AS signal FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    s = R.signal_strength(F.lit(0.9), F.col("n_chars") / 100000, F.col("lang"), F.size(X.words(F.substring("text", 1, 80))), F.floor(F.col("n_chars") / 6))
    return docs.select(F.col("doc_id").alias("id"), F.round(s, 6).alias("signal"))


@query("l20_staleness", M + """, x AS (SELECT id, date_diff('microsecond', ts, now) / 8.64e10 AS age, 14 + 46 * least(value / 200, 1) AS keep FROM m, clock)
SELECT id, round(CASE WHEN age > keep THEN greatest(0.58, 1 - 0.30 * least(1.5, (age - keep) / keep)) ELSE 1 END, 6) AS factor FROM x""")
def _(spark, d):
    m = memories(spark, d)
    age = T.age_hours(F.col("ts"), latest(m)) / 24
    return m.select("id", F.round(R.staleness(age, F.least(F.col("value") / 200, F.lit(1.0)), False), 6).alias("factor"))


@query("l29_merge_score", "SELECT p_partkey AS id, round(0.5 * (p_size / 50) + 0.42 * least(p_retailprice / 2000, 1) + 0.08 * CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END, 6) AS score FROM part")
def _(spark, d):
    s = R.merge_score(F.least(F.col("p_retailprice") / 2000, F.lit(1.0)), F.col("p_size") / 50, F.col("p_brand") == "Brand#2", F.lit(False))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s, 6).alias("score"))


def search(spark, d, text: str = SEARCH, limit: int = 20):
    """Hybrid search: vector and keyword branches, fusion, rerank, gate, diversity."""
    p = R.Profile(text)
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("app"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang").alias("url"), F.substring("text", 1, 60).alias("title"),
        F.substring("text", 1, 240).alias("snippet"), (F.col("doc_id") % 40).cast("string").alias("session"), (F.col("doc_id") * 60_000_000).alias("us"), F.lit(0.93).alias("confidence"), F.lit(0.06).alias("noise"), F.lit("llm").alias("source"), F.lit(1.0).alias("decay"),
    )
    semantic = R.knn(vectors(spark, d), "embedding", QUERY_VECTOR, 64).select("id", "score")
    keyword = R.keyword_search(docs.withColumnRenamed("doc_id", "id"), text, {"text": "text"}, F.lit(0.5), 64).select("id", "score")
    pool = R.fuse({"semantic": semantic, "keyword": keyword}, rows, "text", p, 60)
    newest = rows.agg(F.max("us")).first()[0]
    ranked = R.rerank(pool, p, (F.lit(newest) - F.col("us")) / 3.6e9)
    return R.diversify(R.relevance_gate(ranked, p, F.lit(newest)), limit, p.recent)


GATED = "what is erly thnt"
_STEM = "CASE WHEN strlen(w) > 4 AND ends_with(w, 'ies') THEN left(w, -3) || 'y' WHEN strlen(w) > 5 AND ends_with(w, 'ing') THEN left(w, -3) WHEN strlen(w) > 4 AND ends_with(w, 'ed') THEN left(w, -2) WHEN strlen(w) > 4 AND ends_with(w, 'es') THEN left(w, -2) WHEN strlen(w) > 3 AND ends_with(w, 's') THEN left(w, -1) ELSE w END"


@query("l17_relevance_gate", f"""WITH d AS (SELECT doc_id AS id, 0.2 + (doc_id % 97) / 120 AS score, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, score, list_distinct(list_concat(ws, list_transform(ws, lambda w: {_STEM}))) AS ts FROM d), c AS (SELECT *, (list_contains(ts, 'erly')::INT + list_contains(ts, 'thnt')::INT) / 2 AS cover, max(score) OVER () AS top FROM t),
k AS (SELECT * FROM c WHERE score >= least(0.26, greatest(top * 0.9, 0.01)) AND cover > 0) SELECT id, round(score, 6) AS score FROM k WHERE score >= 0.32 * top OR id = (SELECT arg_max(id, (score, id)) FROM k)""")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", (0.2 + (F.col("doc_id") % 97) / 120).alias("score"), F.col("doc_id").alias("us"))
    return R.relevance_gate(R.with_text(docs, F.col("text")), R.Profile(GATED)).select("id", F.round("score", 6).alias("score"))


@query("r26_hybrid_search")
def _(spark, d):
    return search(spark, d).select("id", "place", F.round("score", 6).alias("score"))


@query("l15_fusion")
def _(spark, d):
    p = R.Profile(SEARCH)
    docs = table(spark, d, "documents").where("text is not null").withColumnRenamed("doc_id", "id")
    semantic = R.knn(vectors(spark, d), "embedding", QUERY_VECTOR, 30).select("id", "score")
    keyword = R.keyword_search(docs, SEARCH, {"text": "text"}, F.lit(0.5), 30).select("id", "score")
    return R.fuse({"semantic": semantic, "keyword": keyword}, docs.select("id", "text"), "text", p).select("id", F.round("score", 6).alias("score"))


@query("r11_temporal_route", M + "SELECT id, round(pow(2.0, -(date_diff('microsecond', ts, now) / 3.6e9) / 24), 6) AS score FROM m, clock WHERE ts >= now - INTERVAL 24 HOUR ORDER BY pow(2.0, -(date_diff('microsecond', ts, now) / 3.6e9) / 24) DESC, id LIMIT 50")
def _(spark, d):
    m = memories(spark, d)
    now = latest(m)
    return R.temporal_route(m.where(T.relative_filter(F.col("ts"), "24h", now)), T.age_hours(F.col("ts"), now), 24, 50).select("id", F.round("score", 6).alias("score"))


@query("r12_entity_route", "WITH x AS (SELECT n_nationkey AS id, lower(n_name) AS l, 0.9 AS c FROM nation) SELECT id, round(CASE WHEN l = 'nation 1' OR regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g') = 'nation 1' THEN 1.0 WHEN regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g') LIKE 'nation 1%' THEN 0.82 ELSE 0 END * 0.95 * c, 6) AS score FROM x WHERE regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g') LIKE 'nation 1%'")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("place").alias("kind"), F.lit(0.9).alias("confidence"))
    return R.entity_route(n, ["Nation 1"], {"place": 0.95}).select("id", F.round("score", 6).alias("score"))


@query("r14_route_fusion", "WITH h AS (SELECT p_partkey AS id, 'vector' AS route, p_size / 50 AS score FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'keyword', 0.6 FROM part WHERE p_name LIKE '%ring%') SELECT id, round(sum(score * CASE route WHEN 'vector' THEN 0.35 ELSE 0.3 END), 6) AS score, round(max(score), 6) AS best, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM h GROUP BY id ORDER BY sum(score * CASE route WHEN 'vector' THEN 0.35 ELSE 0.3 END) DESC, id LIMIT 50")
def _(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("vector").alias("route"), (F.col("p_size") / 50).alias("score"))
    b = p.where("p_name like '%ring%'").select(F.col("p_partkey").alias("id"), F.lit("keyword").alias("route"), F.lit(0.6).alias("score"))
    return R.route_fusion(a.union(b), R.INTENT_WEIGHTS["lookup"]).select("id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), "routes")


_FUSED_SQL = """f AS (SELECT p_partkey AS id, p_retailprice / 2500 AS score, p_size / 100 AS coverage, CASE p_size % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'graph,vector' ELSE 'keyword' END AS routes, p_size % 4 AS path FROM part),
k AS (SELECT * FROM f WHERE contains(routes, 'graph') OR greatest(coverage, least(score, 1.0)) >= 0.3)"""
_VERIFY_SQL = f"""WITH {_FUSED_SQL}, n AS (SELECT count(DISTINCT id) AS backers, count(*) AS kept, max(score) AS top, count(*) FILTER (WHERE routes = 'graph' AND path = 2) AS weak FROM k)
SELECT 'grounded' AS status, '' AS missing, round(least(1.0, least(top, 1.0) * 0.8 + least(kept, 5) * 0.04) * CASE WHEN weak > 0 THEN 0.85 ELSE 1.0 END, 6) AS confidence FROM n
UNION ALL SELECT 'partial', 'no decision evidence; no error evidence', NULL UNION ALL SELECT 'partial', 'no file evidence for a file-seeking query', NULL UNION ALL SELECT 'not_enough_evidence', 'no fused hits', NULL
UNION ALL SELECT 'partial', 'only one memory backs the top result', NULL UNION ALL SELECT 'not_enough_evidence', 'all hits below confidence threshold', NULL"""


@query("r18_verify", _VERIFY_SQL)
def _(spark, d):
    routes = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("graph"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("graph"), F.lit("vector"))).otherwise(F.array(F.lit("keyword")))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2500).alias("score"), (F.col("p_size") / 100).alias("coverage"), routes.alias("routes"), (F.col("p_size") % 4).alias("path_nodes"))
    weak = f.withColumns({"score": F.lit(0.1), "coverage": F.lit(0.1), "routes": F.array(F.lit("keyword"))})
    cases = [R.verify(f, {}, {}), R.verify(f, {"decisions": True, "errors": True}, {}), R.verify(f, {"files": True, "errors": True}, {}), R.verify(f.limit(0), {}, {}), R.verify(f.withColumn("id", F.lit(1)), {}, {}), R.verify(weak, {}, {})]
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("l30_merge_allowed", "WITH s AS (SELECT p_partkey AS id, p_retailprice / 2000 AS score, p_size / 50 AS lexical, (p_partkey % 100) / 100 AS vector, p_partkey % 3 = 0 AS anchor FROM part) SELECT id, CASE WHEN anchor THEN score >= 0.58 AND lexical >= 0.18 ELSE (lexical >= 0.72 AND score >= 0.8) OR (score >= 0.86 AND vector >= 0.82 AND lexical >= 0.28) END AS merged, CASE WHEN anchor THEN lexical >= 0.24 AND score >= 0.46 ELSE lexical >= 0.66 AND score >= 0.74 END AS by_words FROM s")
def _(spark, d):
    score, lexical, vector, anchor = F.col("p_retailprice") / 2000, F.col("p_size") / 50, (F.col("p_partkey") % 100) / 100, F.col("p_partkey") % 3 == 0
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.merge_allowed(score, lexical, vector, anchor).alias("merged"), R.merge_allowed_by_words(score, lexical, anchor).alias("by_words"))


@query("l31_cross_app_merge", """SELECT event_id AS id, coalesce(abs(value * 3e7) <= 2700000000 AND user_id % 3 = event_id % 3 AND (event_id % 4 = event_id % 2
  OR event_id % 2 = 0 AND (event_id % 10) / 10 >= 0.52 OR (event_id % 7) / 6 >= 0.93 AND (event_id % 10) / 10 >= 0.7), false) AS merged FROM events""")
def _(spark, d):
    id = F.col("event_id")
    url = F.concat(F.lit("https://site"), (F.col("user_id") % 3).cast("string"), F.lit(".org/p"), (id % 4).cast("string"), F.lit("?x=1#y"))
    other = F.concat(F.lit(" http://Site"), (id % 3).cast("string"), F.lit(".org/p"), (id % 2).cast("string"), F.lit("/"))
    merged = R.cross_app_merge(F.col("value") * 3e7, url, other, (id % 10) / 10, (id % 7) / 6, id % 2 == 0)
    return table(spark, d, "events").select(id.alias("id"), merged.alias("merged"))


@query("l32_relevant", f"SELECT doc_id AS id, regexp_matches(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '{'|'.join(R.Profile(SEARCH).expanded)}') AS relevant FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), R.relevant(R.Profile(SEARCH), F.col("text")).alias("relevant"))


_ASKED = {
    "timeline of the release": "timeline", "pick up where I left off": "resume_work", "why did the build fail with a panic": "debug", "notes similar to this one": "related_to",
    "what is a vector index": "definition", "how to rotate keys": "how_to", "invoice of march": "lookup",
}


_OPENINGS = [*_ASKED, "Timeline,", "What are", "How can I sort", "Why does", "the meaning of", "Meaning of", "Sequence-of", "picked-up", "find"]
_INTENT_SQL = " ".join(f"WHEN {' OR '.join(f"contains(n, '{x}')" for x in parts)} THEN '{intent}'" for intent, parts in R.INTENT_WORDS)


@query("r02_planner_intent", f"""WITH q AS (SELECT p_partkey AS id, {_OPENINGS}[p_partkey % {len(_OPENINGS)} + 1] || ' ' || p_name AS query FROM part), n AS (SELECT id, query, trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM q)
SELECT id, query, CASE {_INTENT_SQL} WHEN regexp_matches(n, '^(why is |why does |what is|what are|define|meaning of)') THEN 'definition' WHEN regexp_matches(n, '^how (to|do|can)') THEN 'how_to' ELSE 'lookup' END AS intent FROM n""")
def _(spark, d):
    k = F.col("p_partkey")
    opening = F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (k % len(_OPENINGS) + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.concat_ws(" ", opening, "p_name").alias("query")).withColumn("intent", R.planner_intents(F.col("query")))


@query("r20_token_budget", "SELECT doc_id AS id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY n_chars DESC, doc_id) AS used FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 40)) WHERE used <= 4 * 100000")
def _(spark, d):
    top = table(spark, d, "documents").where("text is not null").orderBy(F.desc("n_chars"), "doc_id").limit(40)
    return R.token_budget(top, "text", [F.desc("n_chars"), F.col("doc_id")], 100_000).select(F.col("doc_id").alias("id"))


@query("a37_retrieval_metrics", "WITH g AS (SELECT label % 7 AS query, vec_id AS id, row_number() OVER (PARTITION BY label % 7 ORDER BY vec_id) AS rank FROM embeddings), h AS (SELECT query, sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS h, min(CASE WHEN id % 3 = 0 THEN rank END) AS f FROM g WHERE rank <= 6 GROUP BY query) SELECT round(avg(h / 6), 6) AS precision, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, count(*) FILTER (f = 1) AS top1, count(*) FILTER (f <= 5) AS top5 FROM h")
def _(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 7).alias("query"), F.col("vec_id").alias("id"))
    g = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return stats.retrieval_metrics(g, e.where("id % 3 = 0"), 6)


_W = "0.3 + (c_nationkey % 7) / 10"
_E = f"e AS (SELECT 1000000 + c_custkey AS source, CAST(c_nationkey AS BIGINT) AS target, {_W} AS w FROM customer UNION ALL SELECT 100000000 + o_orderkey, 1000000 + o_custkey, 0.9 FROM orders)"


def graph(spark, d):
    """Orders point to customers, customers to nations: (nodes, edges) of the whole tables."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    e = c.select((1_000_000 + F.col("c_custkey")).alias("source"), F.col("c_nationkey").cast("long").alias("target"), (F.lit(0.3) + (F.col("c_nationkey") % 7) / 10).alias("confidence"))
    e = e.union(o.select((100_000_000 + F.col("o_orderkey")).alias("source"), (1_000_000 + F.col("o_custkey")).alias("target"), F.lit(0.9).alias("confidence"))).withColumn("edge_type", F.lit("uses"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")).union(c.select(1_000_000 + F.col("c_custkey"))).union(o.select(100_000_000 + F.col("o_orderkey")))
    return n, e


@query("g02_bfs", "SELECT CAST(n_nationkey AS BIGINT) AS id, 0 AS hops FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 1000000 + c_custkey, 1 FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 100000000 + o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5")
def _(spark, d):
    n, e = graph(spark, d)
    return G.bfs(G.adjacency(n, e), n.where("id = 5"), 2).select("id", "hops")


@query("g03_bfs_confidence")
def _(spark, d):
    n, e = graph(spark, d)
    return G.bfs(G.adjacency(n, e), n.where("id = 5"), 3).select("id", "hops", F.round("path_confidence", 6).alias("confidence"))


@query("g05_pagerank_hubs")
def _(spark, d):
    n, e = graph(spark, d)
    return G.pagerank(n, G.adjacency(n, e)).orderBy(F.desc("r"), "id").limit(10).select("id", F.round("r", 8).alias("rank"))


@query("g08_components", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS component FROM nation UNION ALL SELECT 1000000 + c_custkey, c_nationkey FROM customer UNION ALL SELECT 100000000 + o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    n, e = graph(spark, d)
    return G.components(n, G.adjacency(n, e))


@query("g09_shortest_path", f"SELECT 2 AS hops, round((0.9 + {_W}) / 2, 6)::DOUBLE AS mean_confidence FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 0")
def _(spark, d):
    n, e = graph(spark, d)
    start = table(spark, d, "orders").where("o_orderkey = 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).first()
    return G.shortest_path(G.adjacency(n, e), 100_000_000, start.c_nationkey).select("hops", "mean_confidence")


@query("g07_bridges")
def _(spark, d):
    n, e = graph(spark, d)
    adj = G.adjacency(n, e)
    return G.bridges(n, adj, G.components(n, adj))


@query("a33_degrees", f"WITH {_E}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e) SELECT id, count(*) AS degree, round(4 + 2 * log2(count(*) + 1), 6) AS size, round(least(1, log2(count(*) + 1) / 6), 6) AS importance FROM x GROUP BY id")
def _(spark, d):
    return G.degrees(graph(spark, d)[1])


@query("a35_communities", "SELECT c_mktsegment AS community, count(*) AS n, round(avg(c_acctbal / 10000), 6) AS importance FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    c = table(spark, d, "customer").select(F.lit("").alias("project"), F.col("c_mktsegment").alias("topic"), F.lit("x").alias("kind"), (F.col("c_acctbal") / 10000).alias("importance"))
    return G.communities(c)


@query("g14_ingest", "SELECT 'memory' AS kind, count(*) AS n FROM events UNION ALL SELECT 'session', count(DISTINCT user_id) FROM events UNION ALL SELECT 'app', count(DISTINCT event_type) FROM events")
def _(spark, d):
    return G.ingest(memories(spark, d))[0].groupBy("kind").agg(F.count("*").alias("n"))


_EDGE_NAMES = [*G.EDGE_ALIASES, "DependsOn", "Contradicts", "EvidencedBy", "Strange"]
_EDGE_SQL = f"""WITH e AS (SELECT p_partkey AS source, {_EDGE_NAMES}[p_partkey % {len(_EDGE_NAMES)} + 1] AS name FROM part),
c AS (SELECT source, CASE name WHEN 'HasTopic' THEN 'MentionedIn' WHEN 'CausedError' THEN 'Causes' WHEN 'ResolvedError' THEN 'Resolves' WHEN 'MadeDecision' THEN 'CreatedBy' WHEN 'CreatedTodo' THEN 'CreatedBy' WHEN 'RelatedTo' THEN 'SimilarTo'
    WHEN 'Before' THEN 'PrecededBy' WHEN 'After' THEN 'FollowedBy' WHEN 'VisitedUrl' THEN 'MentionedIn' WHEN 'UsesFile' THEN 'UsedIn' WHEN 'MentionsEntity' THEN 'MentionedIn' WHEN 'Strange' THEN NULL ELSE name END AS edge_type FROM e)
SELECT source, edge_type, CASE WHEN edge_type IN ('CreatedBy', 'UsedIn', 'DependsOn') THEN 'structural' WHEN edge_type = 'SimilarTo' THEN 'semantic' WHEN edge_type IN ('Causes', 'PrecededBy', 'FollowedBy') THEN 'temporal' WHEN edge_type IN ('Resolves', 'Contradicts') THEN 'conflict' ELSE 'reference' END AS kind FROM c"""


@query("g20_edge_aliases", _EDGE_SQL)
def _(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in _EDGE_NAMES]), (F.col("p_partkey") % len(_EDGE_NAMES) + 1).cast("int"))
    e = G.canonical_edges(table(spark, d, "part").select(F.col("p_partkey").alias("source"), name.alias("edge_type")))
    return e.select("source", "edge_type", G.edge_kind(F.col("edge_type")).alias("kind"))


@query("g13_delete_nodes", f"WITH {_E} SELECT source, target FROM e WHERE target <> 3 AND source NOT IN (SELECT 1000000 + c_custkey FROM customer WHERE c_acctbal < 0) AND target NOT IN (SELECT 1000000 + c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    n, e = graph(spark, d)
    return G.without(n, e, n.where("id = 3").union(table(spark, d, "customer").where("c_acctbal < 0").select(1_000_000 + F.col("c_custkey"))))[1].select("source", "target")


@query("g18_anchors", "SELECT n_nationkey AS id, round(1 - 2 * (n_nationkey + 0.5) / 25, 6) AS y FROM nation")
def _(spark, d):
    return G.anchors(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "id", 25).select("id", "y")
