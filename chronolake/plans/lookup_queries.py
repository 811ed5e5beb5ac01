"""Lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compose as T
from ..functions import text as X
from ..operators import context as C
from ..operators import lookups as K
from ..operators import retrieval as R
from ..operators import runtime_graph as G
from ..sources.memory import MEMORIES as M
from ..sources.memory import memories, table
from ..streaming import merging
from . import graph_queries as GQ
from . import merge_queries as MQ
from . import search_queries as Q
from .registry import query

_COSINE = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {Q._QV}), lambda z: z[1] * z[2])) / (greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-6) * {sum(x * x for x in Q.QUERY_VECTOR) ** 0.5!r})"


@query("v08_nodes_like", f"SELECT vec_id AS id, round({_COSINE}, 6) AS similarity FROM embeddings WHERE vec_id % 3 > 0 ORDER BY {_COSINE} DESC, id LIMIT 15")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 5)).alias("embedding"))  # every third has another dimension
    return K.nodes_like(e, Q.QUERY_VECTOR, 15).select("id", F.round("similarity", 6).alias("similarity"))


@query("g11_node_by_label", "SELECT max(p_partkey) AS id, p_type AS label, p_brand AS kind FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7) AND p_type = (SELECT p_type FROM part WHERE p_partkey = 7) GROUP BY ALL")
def _(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_brand").alias("kind"))
    one = nodes.where("id = 7").first()
    return K.node_named(nodes, one.label, one.kind)


_TASKS = "t AS (SELECT o_orderkey AS id, 'Deliver ' || o_orderpriority AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS memory, [o_custkey + 1, o_custkey + 2][:o_orderkey % 3] AS linked, ['https://t.example/' || (o_custkey % 9), 'https://t.example/' || o_orderstatus][:o_orderkey % 2 + 1] AS urls FROM orders)"


def _tasks(spark, d):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    url = lambda x: F.concat(F.lit("https://t.example/"), x.cast("string"))
    return table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("Deliver "), "o_orderpriority").alias("title"), F.when(k % 3 > 0, u).alias("memory"), F.slice(F.array(u + 1, u + 2), F.lit(1), (k % 3).cast("int")).alias("linked"), F.slice(F.array(url(u % 9), url(F.col("o_orderstatus"))), F.lit(1), (k % 2 + 1).cast("int")).alias("urls"))


@query("g21_task_links", f"WITH {_TASKS} SELECT DISTINCT 'task:' || id AS source, 'memory:' || memory AS target, 'source_memory' AS reason FROM t WHERE memory IS NOT NULL UNION ALL SELECT DISTINCT 'task:' || id, 'memory:' || m, 'linked_memory' FROM (SELECT id, unnest(linked) AS m FROM t) UNION ALL SELECT DISTINCT 'task:' || id, 'url:' || u, 'linked_url' FROM (SELECT id, unnest(urls) AS u FROM t)")
def _(spark, d):
    return K.task_links(_tasks(spark, d))[1]


@query("g21_related_urls", f"WITH {_TASKS} SELECT DISTINCT 'task:' || id AS task, unnest(urls) AS url FROM t")
def _(spark, d):
    return K.related_urls(*K.task_links(_tasks(spark, d)))


@query("j07_tasks_of_similar", f"""WITH {_TASKS}, q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT q.id, vec_id AS peer FROM embeddings, q WHERE vec_id <> q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id) <= 10),
r AS (SELECT DISTINCT 'task:' || id AS task, m FROM (SELECT id, memory AS m FROM t WHERE memory IS NOT NULL UNION ALL SELECT id, unnest(linked) FROM t)) SELECT id, task, count(*) AS votes FROM n JOIN r ON peer = m GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return K.tasks_of_similar(C.nearest(e, e.where("id % 20 = 0"), 10), *K.task_links(_tasks(spark, d)))


@query("j03_node_rows", "SELECT 'n:' || p_partkey AS node, s AS id, c_name AS name FROM (SELECT p_partkey, unnest([p_partkey % 50, p_partkey + 1000000 * (p_partkey % 2)]) AS s FROM part) LEFT JOIN customer ON c_custkey = s")
def _(spark, d):
    p = F.col("p_partkey")
    nodes = table(spark, d, "part").select(F.concat(F.lit("n:"), p.cast("string")).alias("id"), F.array(p % 50, p + 1_000_000 * (p % 2)).alias("sources"))
    return K.node_rows(nodes, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).select("node", "id", "name")


@query("j10_full_records", "SELECT o_orderkey AS hit, o_custkey * 2 AS id, c_name AS name, c_custkey IS NULL AS gone FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("hit"), (F.col("o_custkey") * 2).alias("id"))
    out = K.with_records(rows, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return out.select("hit", "id", F.col("record.name").alias("name"), F.col("record").isNull().alias("gone"))


@query("s17_replaced_rows", "WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 100000000 ELSE 0 END AS id, 'new' AS status FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL FROM n) SELECT id, status, count(l_orderkey) AS children FROM p LEFT JOIN lineitem ON l_orderkey = id GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = o.where("id % 5 = 0").select((F.col("id") + F.when(F.col("id") % 10 == 0, 100_000_000).otherwise(0)).alias("id"), F.lit("new").alias("status"))
    parents, children = K.replaced(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), new)
    return parents.join(children.groupBy("id").agg(F.count("*").alias("children")), "id", "left").na.fill(0, ["children"])


@query("a40_merge_counts", MQ._HEADS + " SELECT app, count(*) AS merged FROM h WHERE head <> id GROUP BY app")
def _(spark, d):
    return K.merge_counts(merging.continued(MQ.anchored(spark, d)))


@query("r30_recent_changes", M + ", x AS (SELECT id, us FROM m, clock WHERE us >= epoch_us(now) - 604800000000 ORDER BY us DESC, id DESC LIMIT 40) SELECT id, us, CAST(row_number() OVER (ORDER BY us, id) AS INTEGER) AS place FROM x")
def _(spark, d):
    m = memories(spark, d)
    now = F.lit(m.agg(F.max("us")).first()[0])
    return K.recent_changes(m, now, 99_999, 40).select("id", "us", "place")  # the look back is cut to a week


@query("r31_active_focus", M + ", x AS (SELECT * FROM m, clock WHERE us >= epoch_us(now) - 86400000000 ORDER BY us DESC, id DESC LIMIT 30) SELECT session, count(*) AS n, string_agg(DISTINCT app, ',' ORDER BY app) AS apps, min(us) AS first_us, max(us) AS last_us, arg_max(app, (us, id)) AS app FROM x GROUP BY session")
def _(spark, d):
    m = memories(spark, d)
    now = F.lit(m.agg(F.max("us")).first()[0])
    return K.active_focus(m, now, 2_000).withColumn("apps", F.array_join("apps", ","))


_INSIGHT = GQ._MEMORY_GRAPH + f""", ed AS (SELECT * FROM ({GQ._EDGES}) WHERE confidence >= 0.4 AND source IS NOT NULL AND target IS NOT NULL),
pn AS (SELECT x.id AS a, min(x.label) AS b, max(x.confidence) AS confidence FROM (SELECT unnest(nodes) AS x FROM n) WHERE x.kind = 'Project' AND contains(x.label, 'Brand#1') GROUP BY x.id),
eg AS (SELECT source AS a, target AS b, edge_type, max(confidence) AS confidence, bool_or(conflict) AS conflict FROM ed GROUP BY source, target, edge_type),
u AS (SELECT * FROM (SELECT 'project' AS part, a, b, confidence FROM pn ORDER BY round(confidence, 9) DESC, a, b LIMIT 5) UNION ALL SELECT * FROM (SELECT 'edge', a, b, confidence FROM eg ORDER BY round(confidence, 9) DESC, a, b LIMIT 3) UNION ALL SELECT * FROM (SELECT 'conflict', a, b, confidence FROM eg WHERE conflict OR edge_type = 'Contradicts' ORDER BY round(confidence, 9) DESC, a, b LIMIT 8))
SELECT part, a, b, round(confidence, 6) AS confidence FROM u"""


@query("r29_insight_context", _INSIGHT)
def _(spark, d):
    nodes, edges = G.memory_graph(GQ.records(spark, d))
    nodes = nodes.groupBy("id", "kind").agg(F.min("label").alias("label"), F.round(F.max("confidence"), 9).alias("confidence"))
    edges = edges.groupBy("source", "target", "edge_type").agg(F.round(F.max("confidence"), 9).alias("confidence"), F.bool_or("conflict").alias("conflict"))
    return K.insight_context(nodes, edges, "Brand#1").select("part", "a", "b", F.round("confidence", 6).alias("confidence"))


_PLAIN = "trim(regexp_replace({0}, '[\\s\\p{{Cc}}]+', ' ', 'g'))"
_SUMMARY = "[' LLM', 'fallback', 'vlm', '', 'ocr'][doc_id % 5 + 1]"


@query("t17_compact_text", f"""WITH x AS (SELECT doc_id AS id, lower(trim({_SUMMARY})) AS s, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_PLAIN.format("coalesce(text, '')")} END AS a, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_PLAIN.format("coalesce(text, '') || chr(7) || source")} END AS b FROM documents)
SELECT id, CASE WHEN s IN ('llm', 'vlm') AND a <> '' THEN left(a, 360) WHEN b <> '' THEN left(b, CASE WHEN s = 'fallback' THEN 560 ELSE 420 END) ELSE left(a, CASE WHEN s IN ('llm', 'vlm') THEN 360 WHEN s = 'fallback' THEN 560 ELSE 420 END) END AS text FROM x""")
def _(spark, d):
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    source = F.element_at(F.array(*[F.lit(x) for x in (" LLM", "fallback", "vlm", "", "ocr")]), (k % 5 + 1).cast("int"))
    snippet, clean = F.when(k % 3 == 0, " ").otherwise(text), F.when(k % 7 == 0, "\n").otherwise(F.concat(text, F.lit("\x07"), "source"))
    return table(spark, d, "documents").select(k.alias("id"), T.compact(source, snippet, clean).alias("text"))


_FIELDS = {"intent": "CASE WHEN p_partkey % 3 = 0 THEN ' Buy ' || p_name ELSE '' END", "project": "CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE p_brand END", "topic": "p_type", "happened": "repeat(p_name || ' ', p_size)"}
_LISTS = {"entities": ("[p_brand, p_name][:p_partkey % 3]", ", "), "errors": ("[p_type][:p_partkey % 2]", "; "), "todos": ("CASE WHEN p_partkey % 5 = 0 THEN ['first ' || p_name, 'second'] ELSE ['step ' || p_brand][:p_partkey % 2] END", "; ")}
_SEGMENT = "CASE WHEN trim({1}) <> '' AND lower(trim({1})) <> 'unknown' THEN '{0}: ' || trim({1}) END"


@query("t18_embedding_text", "SELECT p_partkey AS id, left(concat_ws(chr(10), " + ", ".join(_SEGMENT.format(*x) for x in (("intent", _FIELDS["intent"]), ("project", _FIELDS["project"]), ("topic", _FIELDS["topic"]), ("what_happened", _FIELDS["happened"]), *[(k, f"array_to_string({v}, '{j}')") for k, (v, j) in _LISTS.items()])) + "), 2000) AS text FROM part")
def _(spark, d):
    k, none, text = F.col("p_partkey"), F.array().cast("array<string>"), F.lit(None).cast("string")
    some = lambda n, *v: F.slice(F.array(*v), F.lit(1), n.cast("int"))
    row = {name: none if joint else text for _, name, joint in T.SEGMENTS}
    row |= {"intent": F.when(k % 3 == 0, F.concat(F.lit(" Buy "), "p_name")).otherwise(""), "project": F.when(k % 4 == 0, "Unknown").otherwise(F.col("p_brand")), "topic": F.col("p_type"), "happened": F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size").cast("int"))}
    row |= {"entities": some(k % 3, F.col("p_brand"), F.col("p_name")), "errors": some(k % 2, F.col("p_type")), "todos": F.when(k % 5 == 0, F.array(F.concat(F.lit("first "), "p_name"), F.lit("second"))).otherwise(none), "steps": some(k % 2, F.concat(F.lit("step "), "p_brand"))}
    return table(spark, d, "part").select(k.alias("id"), T.embedding_text(row).alias("text"))


@query("t23_ungrounded_tokens", """WITH x AS (SELECT page_id AS id, 'see (' || url || '), a/b or src/lib.rs, ' || CASE WHEN page_id % 2 = 0 THEN 'std::vec' ELSE 'a::b' END || ' and words' AS field, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || ' src/lib.rs' WHEN 2 THEN url || ' src/lib.rs' ELSE 'src/lib.rs' END AS evidence FROM pages WHERE url IS NOT NULL),
t AS (SELECT id, evidence, i, trim_w AS w FROM (SELECT id, evidence, generate_subscripts(string_split(field, ' '), 1) AS i, regexp_replace(unnest(string_split(field, ' ')), '^[^\\p{L}\\p{N}/:]+|[^\\p{L}\\p{N}/:]+$', '', 'g') AS trim_w FROM x))
SELECT id, arg_min(w, i) AS token FROM t WHERE (contains(w, '://') OR (contains(w, '/') AND strlen(w) > 4) OR (contains(w, '::') AND strlen(w) > 4)) AND NOT contains(evidence, w) GROUP BY id""")
def _(spark, d):
    k, url = F.col("page_id"), F.col("url")
    field = F.concat(F.lit("see ("), url, F.lit("), a/b or src/lib.rs, "), F.when(k % 2 == 0, "std::vec").otherwise("a::b"), F.lit(" and words"))
    evidence = F.when(k % 4 == 0, url).when(k % 4 < 3, F.concat(url, F.lit(" src/lib.rs"))).otherwise("src/lib.rs")
    return table(spark, d, "pages").where("url is not null").select(k.alias("id"), T.ungrounded(field, evidence).alias("token")).where("token is not null")


_ASKED = "economy brushed brand"


@query("l16_name_factors", """WITH x AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' ' || CASE WHEN p_partkey % 5 = 0 THEN 'Back - Forward' ELSE p_type END), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm, CASE WHEN p_partkey % 7 = 0 THEN 'New  Tab' ELSE p_name END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://www.brand' || p_size || '.example/x' END AS url, lower(p_type) AS c1, lower(p_brand) AS c2, p_partkey AS k FROM part)
SELECT id, round(CASE WHEN k % 7 = 0 OR contains(norm, 'new tab') OR contains(norm, 'tab strip') OR contains(norm, 'back forward') OR contains(norm, 'home trending') OR contains(norm, 'notifications') THEN 0.62 ELSE 1 END * CASE WHEN url IS NOT NULL THEN 1.08 ELSE 1 END
  * (1 + least(0.3, 0.12 * ((contains(c1, 'economy') OR contains(c1, 'brushed'))::INT + 1 + (k % 4 = 0)::INT))) * (1 + least(0.2, 0.08 * (k % 2 + (k % 6 = 0)::INT))), 6) AS factor FROM x""")
def _(spark, d):
    k = F.col("p_partkey")
    p = R.Profile(_ASKED)
    norm = X.normalise(F.concat_ws(" ", "p_name", F.when(k % 5 == 0, "Back - Forward").otherwise(F.col("p_type"))))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.brand"), F.col("p_size").cast("string"), F.lit(".example/x")))
    categories = F.concat(F.array("p_type", "p_brand"), F.when(k % 4 == 0, F.array(F.lit("Brushed"))).otherwise(F.array().cast("array<string>")))
    aliases = F.concat(F.slice(F.array(F.lit("The Economy")), F.lit(1), (k % 2).cast("int")), F.when(k % 6 == 0, F.array(F.lit("y br"), F.lit("x"))).otherwise(F.array(F.lit("b"))))
    found = R.name_factors(p, norm, F.when(k % 7 == 0, "New  Tab").otherwise(F.col("p_name")), url, categories, aliases)
    factor = found[0] * found[1] * found[2] * found[3]
    return table(spark, d, "part").select(k.alias("id"), F.round(factor, 6).alias("factor"))


@query("k03_oldest_first", M + "SELECT id, row_number() OVER (ORDER BY us, id) AS place FROM m")
def _(spark, d):
    return K.oldest_first(memories(spark, d)).select("id", "place")


_SPOKEN = ["the", "data", "and", "please"]


@query("k11_spoken_hits", "WITH s AS (SELECT conv_id AS meeting, turn * 7 % 5 AS start, turn AS index, (" + " + ".join(f"contains(lower(coalesce(text, '')), '{t}')::INT" for t in _SPOKEN) + f") / {len(_SPOKEN)} AS score FROM conversations) SELECT meeting, start, index, score FROM s WHERE score > 0 ORDER BY score DESC, start, index, meeting LIMIT 25")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("meeting"), (F.col("turn") * 7 % 5).alias("start"), F.col("turn").alias("index"), "text")
    return K.spoken_hits(c, _SPOKEN, 25).drop("text")
