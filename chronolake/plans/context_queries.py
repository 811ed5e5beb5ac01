"""Context products over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as C
from ..operators import retrieval as R
from ..sources.memory import MEMORIES as M
from ..sources.memory import memories, table
from .registry import query


@query("a29_project_pages", M + "SELECT project AS key, min(us) AS first_us, max(us) AS last_us, count(*) AS support, round(avg(value / 100), 6) AS confidence, CASE WHEN count(*) >= 4 THEN 'stable' ELSE 'emerging' END AS stability, 'project' AS kind FROM m GROUP BY project ORDER BY last_us DESC, key LIMIT 240")
def _(spark, d):
    m = memories(spark, d).withColumn("confidence", F.col("value") / 100)
    return C.knowledge_pages(m, "project", F.col("project"))


@query("a29_topic_pages", M + "SELECT json_extract_string(props, '$.k') AS key, min(us) AS first_us, max(us) AS last_us, count(*) AS support, round(avg(value / 100), 6) AS confidence, CASE WHEN count(*) >= 4 THEN 'stable' ELSE 'emerging' END AS stability, 'topic' AS kind FROM m GROUP BY 1 HAVING count(*) >= 2 ORDER BY last_us DESC, key LIMIT 240")
def _(spark, d):
    m = memories(spark, d).withColumn("confidence", F.col("value") / 100)
    return C.knowledge_pages(m, "topic", F.get_json_object("props", "$.k"), 2)


@query("a30_evidence_pack", "SELECT 'words' AS kind, w AS value, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w UNION ALL SELECT 'brand', p_brand, string_agg(DISTINCT p_partkey, ',' ORDER BY p_partkey) FROM part GROUP BY p_brand")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"), F.array("p_brand").alias("brand"))
    return C.evidence_pack(p, ["words", "brand"]).select("kind", "value", F.array_join("ids", ",").alias("ids"))


@query("j11_related_ids", "SELECT DISTINCT c_custkey AS id, r AS related FROM (SELECT c_custkey, unnest([c_custkey // 2, c_custkey + 1, c_custkey // 2]) AS r FROM customer) WHERE r <> c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.floor(F.col("c_custkey") / 2).cast("long")).alias("parent"), F.array(F.col("c_custkey") + 1, F.floor(F.col("c_custkey") / 2).cast("long")).alias("near"))
    return C.related_ids(c, ["parent", "near"])


@query("j12_linked_tasks", "SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey IN (o.o_orderkey, o.o_orderkey + 1) AND l_returnflag = CASE o.o_orderstatus WHEN 'O' THEN 'N' WHEN 'F' THEN 'R' ELSE 'A' END)")
def _(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.translate("o_orderstatus", "OFP", "NRA").alias("project"), F.col("o_orderkey").alias("source"), F.array(F.col("o_orderkey") + 1).alias("linked"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("project"))
    return C.linked_tasks(t, e).select("id")


@query("j13_pruned_tasks", "SELECT o_orderkey AS id, CASE WHEN c_acctbal < 0 THEN 'dismissed' ELSE o_orderstatus END AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("status"))
    return C.pruned_tasks(t, table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))).select("id", "status")


_NEAR = """q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
n AS (SELECT q.id, vec_id AS peer, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE vec_id <> q.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, peer) AS rank FROM n)"""


def _nearest(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e, C.nearest(e, e.where("id % 20 = 0"), 10)


@query("j20_knn_join", f"WITH {_NEAR} SELECT id, peer, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def _(spark, d):
    return _nearest(spark, d)[1].select("id", "peer", F.round("similarity", 6).alias("similarity"), "rank")


@query("v15_auto_cluster", f"WITH {_NEAR}, x AS (SELECT k.id, k.s, CASE WHEN peer % 3 = 0 THEN peer % 7 END AS task FROM k WHERE rank <= 10 AND s >= 0.1) SELECT id, CASE WHEN count(task) > 0 THEN 'join' WHEN count(*) >= 2 THEN 'seed' ELSE 'none' END AS action, count(*) AS peers FROM x GROUP BY id")
def _(spark, d):
    e, near = _nearest(spark, d)
    tasks = e.where("id % 3 = 0").select(F.col("id").alias("peer"), (F.col("id") % 7).alias("task"))
    return C.auto_cluster(near, tasks, 0.1).select("id", "action", "peers")


@query("v16_suggestion")
def _(spark, d):
    e, near = _nearest(spark, d)
    return C.suggestion(near, e.where("id % 2 = 0"), 0.1).select("id", "peer")


@query("l27_autofill", "SELECT p_brand AS value, round(max(0.28 * p_size / 50 + 0.28 * 0.9 + 0.20 * 0.5 + 0.10 * 0.93 + 0.08 * 0.4 + 0.06 * 0.7 - 0.08 * 0.1), 6) AS score FROM part GROUP BY p_brand")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("value"), (F.col("p_size") / 50).alias("search"), *[F.lit(v).alias(k) for k, v in {"extraction": 0.9, "context": 0.5, "confidence": 0.93, "document": 0.4, "recency": 0.7, "noise": 0.1}.items()])
    return C.autofill(p).select("value", F.round("score", 6).alias("score"))


@query("l33_ui_relevance", "SELECT p_partkey AS id, round(least(1, 0.8::DOUBLE * CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%blue%' THEN 1 ELSE 0 END + 0.3 * CASE WHEN lower(p_brand) LIKE '%ring%' OR lower(p_brand) LIKE '%blue%' THEN 1 ELSE 0 END), 6) AS relevance FROM part")
def _(spark, d):
    r = C.ui_relevance(R.Profile("blue ring"), F.col("p_name"), F.lit(""), F.col("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(r.cast("double"), 6).alias("relevance"))


@query("r25_cards", M + "SELECT session, round(least(1.0, sum(s / k) / sum(1.0 / k) + 0.04 * count(*)), 6) AS card_score, round((max(us) - min(us)) / 6e7, 6) AS minutes, count(*) AS n FROM (SELECT session, us, value / 5000 AS s, row_number() OVER (PARTITION BY session ORDER BY value / 5000 DESC, id) AS k FROM m WHERE app = 'error') GROUP BY session ORDER BY card_score DESC, session LIMIT 12")
def _(spark, d):
    m = memories(spark, d).where("app = 'error'").withColumns({"score": F.col("value") / 5000, "title": F.col("app")})
    return C.cards(m, "session", "score").drop("title")


@query("r27_errors", M + "SELECT id, us, k AS error FROM (SELECT id, us, json_extract_string(props, '$.k') AS k FROM m WHERE app = 'error' AND us >= 1704844800000000) QUALIFY row_number() OVER (PARTITION BY k ORDER BY us DESC, id) = 1 ORDER BY us DESC, id LIMIT 20")
def _(spark, d):
    m = memories(spark, d).where("app = 'error'").select("id", "us", F.array(F.get_json_object("props", "$.k")).alias("errors"))
    return C.errors(m, 1_704_844_800_000_000, 20)


@query("r32_source_evidence", "SELECT page, id, source FROM (SELECT c_custkey AS page, unnest([c_custkey * 2, c_custkey + 900]) AS id FROM customer) LEFT JOIN documents ON doc_id = id")
def _(spark, d):
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey") * 2, F.col("c_custkey") + 900).alias("support"))
    return C.source_evidence(pages, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"))


@query("r34_open_tasks", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate, o_orderkey LIMIT 8")
def _(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("title"))
    return C.open_tasks(t, "2-high").select("id")


@query("r23_working_state", M + ", l AS (SELECT arg_max(app, (us, id)) AS app, arg_max(project, (us, id)) AS project, max(us) AS last FROM m) SELECT app, project, 60.0::DOUBLE AS idle_minutes, (SELECT count(*) FROM m, l WHERE us >= last) AS last_hour, true AS idle FROM l")
def _(spark, d):
    m = memories(spark, d)
    return C.working_state(m, m.agg(F.max("us")).first()[0] + 3_600_000_000)


@query("g15_entities")
def _(spark, d):
    return C.entity_nodes(table(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("id"), F.concat_ws(" ", "html", "url").alias("text")), "text")


@query("g28_node_text", "SELECT n_nationkey AS id FROM nation WHERE contains(lower(n_name), 'tion_1')")
def _(spark, d):
    return C.node_text_search(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), "TION_1").select("id")


@query("r38_explanation")
def _(spark, d):
    p = R.Profile("The heatou ononat shheed")
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), C.explanation(p, F.col("text"), F.col("doc_id").cast("double")).alias("why"))


@query("l22_coverage_rerank")
def _(spark, d):
    p = R.Profile("The heatou ononat shheed")
    pool = R.with_text(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.lit(0.5).alias("score")), F.col("text"))
    return C.coverage_rerank(pool, p).select("id", F.round("score", 6).alias("score"))


@query("s21_key_values", M + ", l AS (SELECT session AS key, arg_max(props, (us, props)) AS payload, max(us) AS us, arg_max(app, (us, props)) AS app FROM m GROUP BY session) SELECT key, payload, us FROM l WHERE app <> 'error'")
def _(spark, d):
    m = memories(spark, d).select(F.col("session").alias("key"), F.when(F.col("app") != "error", F.col("props")).alias("payload"), "us")
    return C.key_values(m)


@query("a39_document_frequency", "SELECT w AS term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM conversations) GROUP BY w HAVING count(*) >= 5")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")


@query("a28_open_issues", M + """, x AS (SELECT us, id, 'i' || (CAST(session AS INT) % 8) AS issue, 'Issue of ' || project AS title, repeat(coalesce(props, ''), 30) AS summary, id % 2 = 0 AS done FROM m WHERE app = 'error'),
f AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY us, id) AS rn FROM x)
SELECT issue, title, CASE WHEN length(summary) > 140 THEN left(summary, 137) || '...' ELSE summary END AS summary, CASE WHEN done THEN 'resolved' ELSE 'open' END AS status FROM f WHERE rn = 1 ORDER BY us, id LIMIT 5""")
def _(spark, d):
    key = F.concat(F.lit("i"), (F.col("session").cast("int") % 8).cast("string"))
    entity = lambda kind, key, name: F.struct(kind.alias("kind"), key.alias("key"), name.alias("name"))
    both = F.array(entity(F.lit("file"), F.lit("a.txt"), F.lit("a.txt")), entity(F.when(F.col("app") == "error", "issue").otherwise("app"), key, F.concat(F.lit("Issue of "), "project")))
    e = memories(spark, d).select("us", "id", F.repeat(F.coalesce("props", F.lit("")), 30).alias("summary"), F.when(F.col("id") % 2 == 0, "succeeded").otherwise("failed").alias("outcome"), both.alias("entities"))
    return C.open_issues(e)
