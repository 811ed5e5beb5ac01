"""Staged search, context packs, the decision ledger and change deltas over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch as D
from ..operators import packs as P
from ..operators import retrieval as R
from ..operators.checkpoints import new_folder
from ..sources.memory import table
from . import search_queries as Q
from .registry import query

_VARIANTS = {"few": ["qqzx wvvk", "ononat shheed", "erly", "thnt"], "many": ["erly", "thnt", "heatou"]}


def _variant(i: int, text: str) -> str:
    p = R.Profile(text)
    terms = p.primary + p.numbers
    has = lambda t: f"contains(lower(text), '{t}')"
    weight = " + ".join([f"CASE WHEN {has(t)} THEN 1.1 ELSE 0 END" for t in terms] + ([f"CASE WHEN {has(p.phrase)} THEN 1.1 ELSE 0 END"] if p.phrase else []))
    share = " + ".join(f"CASE WHEN {has(t)} THEN 1.0 ELSE 0 END" for t in terms)
    return f"""SELECT doc_id AS id, {i} AS variant, {max(0.84, 1 - 0.07 * i)} * (0.86 * (0.7 * least(1, ({weight}) / (2.8 * {len(terms)})) + 0.3 * ({share}) / {len(terms)}) + 0.07) AS score FROM documents WHERE {' OR '.join(map(has, terms))}"""


def _staged(variants: list[str], limit: int = 20) -> str:
    return f"""WITH every AS ({' UNION ALL '.join(_variant(i, v) for i, v in enumerate(variants))}),
h AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY variant ORDER BY score DESC, id DESC) <= {limit}),
n AS (SELECT variant, count(*) AS new FROM (SELECT id, min(variant) AS variant FROM h GROUP BY id) GROUP BY variant),
s AS (SELECT i AS variant, coalesce((SELECT sum(new) FROM n WHERE n.variant < i), 0) AS known FROM range({len(variants)}) t(i)),
k AS (SELECT h.* FROM h WHERE variant < coalesce((SELECT min(variant) FROM s WHERE variant > 0 AND known >= 18), 99))
SELECT id, round(score, 6) AS score, variant FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, variant) = 1) ORDER BY score DESC, id DESC LIMIT {limit}"""


def _search(spark, d, variants):
    docs = table(spark, d, "documents").withColumnsRenamed({"doc_id": "id"}).withColumn("us", F.col("id"))
    return D.variant_search(docs, variants, {"text": "text"}, F.lit(0.5), 20).withColumn("score", F.round("score", 6))


@query("l06_variants_needed", _staged(_VARIANTS["few"]))
def _(spark, d):
    return _search(spark, d, _VARIANTS["few"])


@query("l06_variants_not_needed", _staged(_VARIANTS["many"]))
def _(spark, d):
    return _search(spark, d, _VARIANTS["many"])


_GRAPH = """docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text FROM documents),
m AS (SELECT 'S:' || source AS node, doc_id AS id FROM docs UNION ALL SELECT 'L:' || lang, doc_id FROM docs WHERE doc_id % 10 = 0),
e AS (SELECT 'S:' || source AS source, 'L:' || lang AS target, CASE WHEN lang = 'en' THEN 'SimilarTo' ELSE 'PartOf' END AS edge_type, least(0.95, 0.3 + count(*) / 200) AS confidence FROM docs GROUP BY ALL),
b AS (SELECT source AS a, target AS b, edge_type, confidence AS c FROM e UNION ALL SELECT target, source, edge_type, confidence FROM e)"""


def _network(spark, d):
    docs = table(spark, d, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")], "text")
    source, lang = F.concat(F.lit("S:"), "source"), F.concat(F.lit("L:"), "lang")
    members = docs.select(source.alias("node"), F.col("doc_id").alias("id")).unionByName(docs.where("doc_id % 10 = 0").select(lang.alias("node"), F.col("doc_id").alias("id")))
    edges = docs.groupBy(source.alias("source"), lang.alias("target"), F.when(F.col("lang") == "en", "SimilarTo").otherwise("PartOf").alias("edge_type")).agg(F.least(F.lit(0.95), 0.3 + F.count("*") / 200).alias("confidence"))
    return docs, members, edges


_STEP = "a || ' ' || edge_type || ' ' || b"
_DISPATCH = f"""WITH {_GRAPH}, v AS (SELECT id, CASE WHEN d <= 4 THEN greatest(0, least(1, 1 - d / 2)) ELSE 1 / (1 + d) END AS score, 'vector' AS route FROM (SELECT vec_id AS id, {Q._D2} AS d FROM embeddings) ORDER BY d, id LIMIT 40),
k AS (SELECT id, score, 'keyword' AS route FROM ({_variant(0, Q.SEARCH)}) ORDER BY score DESC, id LIMIT 20),
n AS (SELECT doc_id AS id, 0.5 + (doc_id % 10) / 20 AS score, 'entity' AS route FROM docs WHERE source = 'src3'),
h AS (FROM v UNION ALL FROM k UNION ALL FROM n),
seeds AS (SELECT id, max(score) AS score FROM (SELECT * FROM h QUALIFY route = 'entity' OR row_number() OVER (PARTITION BY route ORDER BY score DESC, id) <= 5) GROUP BY id),
st AS (SELECT DISTINCT node AS start FROM m JOIN seeds USING (id)),
h1 AS (SELECT start, b AS node, c AS conf, [{_STEP}] AS path FROM st JOIN b ON a = start WHERE b <> start QUALIFY row_number() OVER (PARTITION BY start, b ORDER BY c DESC, [{_STEP}]) = 1),
h2 AS (SELECT start, b AS node, least(conf, c) AS conf, list_append(path, {_STEP}) AS path FROM h1 JOIN b ON a = node WHERE b <> start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = h1.start AND x.node = b)
  QUALIFY row_number() OVER (PARTITION BY start, b ORDER BY least(conf, c) DESC, list_append(path, {_STEP})) = 1),
g AS (SELECT t.id, least(1, 0.58 * s.score + 0.42 * conf) * CASE WHEN r.node LIKE 'L:%' THEN 0.9 ELSE 1 END AS score, path FROM (FROM h1 UNION ALL FROM h2) r JOIN m AS sm ON sm.node = r.start JOIN seeds s ON s.id = sm.id JOIN m AS t ON t.node = r.node WHERE t.id <> s.id),
w AS (SELECT id, max(score) AS score, arg_min(path, (-score, path)) AS path FROM g GROUP BY id ORDER BY score DESC, id LIMIT 25)
SELECT id, route, round(score, 6) AS score, NULL AS path FROM h UNION ALL SELECT id, 'graph', round(score, 6), array_to_string(path, ' > ') FROM w"""


@query("r07_route_dispatch", _DISPATCH)
def _(spark, d):
    docs, members, edges = _network(spark, d)
    texts = docs.withColumnRenamed("doc_id", "id")
    routes = {
        "vector": lambda: R.knn(Q.vectors(spark, d), "embedding", Q.QUERY_VECTOR, 40),
        "keyword": lambda: R.keyword_search(texts, Q.SEARCH, {"text": "text"}, F.lit(0.5), 20),
        "entity": lambda: texts.where("source = 'src3'").withColumn("score", 0.5 + (F.col("id") % 10) / 20),
        "temporal": lambda: texts.select("no_such_column"),  # a route that fails is left out
    }
    factor = members.select("node").distinct().select("node", F.when(F.col("node").startswith("L:"), 0.9).otherwise(1.0).alias("factor"))
    out = D.dispatch(spark, ["graph", "keyword", "temporal", "vector", "entity", "vector"], routes, lambda seeds: D.graph_hits(seeds, members, edges, 2, ["SimilarTo", "PartOf"], factor))
    return out.select("id", "route", F.round("score", 6).alias("score"), F.when(F.col("path").isNotNull(), F.array_join("path", " > ")).alias("path"))


_SECTIONS = [*P.SECTIONS, "issues"]
_ITEMS = f"""i AS (SELECT p_partkey % 100 AS pack, least(12000, greatest(600, 500 + 3 * (p_partkey % 100))) AS budget, {_SECTIONS}[(p_partkey // 100) % 6 + 1] AS section, p_partkey // 600 AS rank, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS fixed,
  trim(repeat(p_name || ' ', 1 + p_size % 4)) AS title, repeat(p_type || ' ', p_size % 8) AS body, CASE WHEN p_size > 25 THEN repeat('é' || p_name, p_size % 7) ELSE '' END AS more FROM part)"""


def _cut(c: str, n: str) -> str:
    return f"CASE WHEN {n} IS NULL OR length({c}) <= {n} THEN {c} ELSE left({c}, CAST(greatest(0, {n} - 3) AS INT)) || '...' END"


_LIMITS = ", ".join(f"('{s}', {v[0]}, {v[1]}, {v[2][0] or 'NULL'}, {v[2][1] or 'NULL'}, {v[2][2] or 'NULL'})" for s, v in P.SECTIONS.items())
_MADE = f"{_cut('title', 'c0')} AS title, {_cut('body', 'least(room, c1)')} AS body, CASE WHEN c2 IS NULL THEN more ELSE {_cut('more', 'least(room, c2)')} END AS more"
_PACKS = f"""WITH RECURSIVE {_ITEMS}, lim(section, share, least_chars, c0, c1, c2) AS (VALUES {_LIMITS}),
o AS (SELECT i.*, c0, c1, c2, share, least_chars, row_number() OVER (PARTITION BY pack, section ORDER BY rank) AS rn FROM i LEFT JOIN lim USING (section)),
f AS (SELECT pack, budget, section, rank, rn, CAST(greatest(floor(budget * 4 * share + 1e-6), least_chars) AS BIGINT) AS room, fixed, title, body, more, c0, c1, c2 FROM o WHERE rn = 1 AND share IS NOT NULL
  UNION ALL SELECT o.pack, o.budget, o.section, o.rank, o.rn, greatest(0, f.room - (SELECT strlen(f.fixed) + strlen(z.title) + strlen(z.body) + strlen(z.more) FROM (SELECT {_MADE.replace('title', 'f.title').replace('body', 'f.body').replace('more', 'f.more').replace('AS f.', 'AS ').replace('room', 'f.room').replace('c0', 'f.c0').replace('c1', 'f.c1').replace('c2', 'f.c2')}) z)),
    o.fixed, o.title, o.body, o.more, o.c0, o.c1, o.c2 FROM f JOIN o ON o.pack = f.pack AND o.section = f.section AND o.rn = f.rn + 1),
cut AS (SELECT pack, budget, section, rank, fixed, {_MADE} FROM f WHERE room > 0 UNION ALL SELECT pack, budget, section, rank, fixed, title, body, more FROM o WHERE share IS NULL)"""


def _pack_items(spark, d):
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    section = F.element_at(F.array(*[F.lit(s) for s in _SECTIONS]), (F.floor(k / 100) % 6 + 1).cast("int"))
    times = lambda c, n: F.repeat(c, n.cast("int"))
    return p.select(
        (k % 100).alias("pack"), P.budget_of(500 + 3 * (k % 100)).alias("budget"), section.alias("section"), F.floor(k / 600).alias("rank"), F.when(k % 3 == 0, F.col("p_brand")).alias("fixed"), F.trim(times(F.concat("p_name", F.lit(" ")), 1 + size % 4)).alias("title"),
        times(F.concat("p_type", F.lit(" ")), size % 8).alias("body"), F.when(size > 25, times(F.concat(F.lit("é"), "p_name"), size % 7)).alias("more"),
    )


@query("r20_section_budgets", _PACKS + " SELECT pack, section, rank, fixed, title, body, more FROM cut")
def _(spark, d):
    return P.cut_sections(_pack_items(spark, d)).drop("budget")


_TURN = "CASE section WHEN 'evidence' THEN 0 WHEN 'decisions' THEN 1 WHEN 'issues' THEN 2 WHEN 'tasks' THEN 3 END"


@query("r20_give_back", _PACKS + f""", s AS (SELECT pack, budget, section, rank, length(fixed || title || body || more) + 20 AS chars, {_TURN} AS turn FROM cut), t AS (SELECT pack, sum(chars) + 700 + pack * 17 AS total FROM s GROUP BY pack),
g AS (SELECT s.*, total, CASE WHEN turn IS NOT NULL AND ceil((total - coalesce(sum(chars) FILTER (turn IS NOT NULL) OVER (PARTITION BY pack ORDER BY turn NULLS LAST, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 4) > budget THEN 1 ELSE 0 END AS goes FROM s JOIN t USING (pack))
SELECT pack, section, rank, CAST(ceil((total - sum(chars * goes) OVER (PARTITION BY pack)) / 4) AS BIGINT) AS tokens FROM g QUALIFY goes = 0""")
def _(spark, d):
    items = P.cut_sections(_pack_items(spark, d))
    items = items.withColumn("chars", F.length(F.concat("fixed", "title", "body", "more")) + 20)
    base = items.select("pack", (700 + F.col("pack") * 17).alias("chars")).distinct()
    return P.give_back(items.select("pack", "budget", "section", "rank", "chars"), base).select("pack", "section", "rank", "tokens")


#: Orders as activities of projects, customers' proposals as decisions.
_LEDGER = """ev AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us, 'P ' || (o_custkey % 20) AS project, CASE WHEN o_orderkey % 3 = 0 THEN ['Ship by ' || o_orderpriority, 'ship BY ' || o_orderpriority] WHEN o_orderkey % 3 = 1 THEN ['Ask client ' || (o_custkey % 50)] ELSE [] END AS decisions,
  ['src/' || o_orderstatus || '.py', 'docs/' || (o_custkey % 4) || '.md'][:o_orderkey % 3] AS files, CASE WHEN o_orderkey % 5 = 4 THEN ['Call ' || o_custkey] ELSE [] END AS next_steps, (o_orderkey % 10) / 10 AS confidence FROM orders),
pr AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN 'P ' || (c_custkey % 20) END AS project, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE ' ' || c_name END AS title, c_mktsegment || ' ' AS summary, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'ann ' END AS by, [c_custkey, c_custkey + 1, c_custkey * 1000000] AS evidence FROM customer WHERE c_custkey % 20 < 15)"""


def _ledger(spark, d):
    """Two batches of decisions, the second one appended twice."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k, u, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    none = F.array().cast("array<string>")
    said = F.when(k % 3 == 0, F.array(text("Ship by ", F.col("o_orderpriority")), text("ship BY ", F.col("o_orderpriority")))).when(k % 3 == 1, F.array(text("Ask client ", u % 50))).otherwise(none)
    files = F.slice(F.array(text("src/", F.col("o_orderstatus"), ".py"), text("docs/", u % 4, ".md")), F.lit(1), (k % 3).cast("int"))
    events = o.select(k.alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), text("P ", u % 20).alias("project"), said.alias("decisions"), files.alias("files"), F.when(k % 5 == 4, F.array(text("Call ", u))).otherwise(none).alias("next_steps"), ((k % 10) / 10).alias("confidence"))
    proposals = c.where(n % 20 < 15).select(n.alias("id"), F.when(n % 6 > 0, text("P ", n % 20)).alias("project"), F.when(n % 9 == 0, " ").otherwise(text(" ", F.col("c_name"))).alias("title"), F.concat("c_mktsegment", F.lit(" ")).alias("summary"), F.when(n % 2 == 0, "").otherwise("ann ").alias("by"), F.array(n, n + 1, n * 1_000_000).alias("evidence"))
    ledger = P.Ledger(spark, new_folder(spark, "ledger"))
    for no in (0, 1, 1):
        ledger.append(no, proposals.where(F.col("id") % 20 < 8 if no == 0 else F.col("id") % 20 >= 5), c.select(n.alias("id")), events)
    return ledger


@query("r35_decision_ledger", f"WITH {_LEDGER}, b AS (SELECT * FROM pr WHERE id % 20 < 8 UNION ALL SELECT * FROM pr WHERE id % 20 >= 5), cc AS (SELECT list(c_custkey) AS every FROM customer) SELECT id, project, trim(title) AS title, trim(summary) AS summary, CASE WHEN trim(\"by\") = '' THEN 'agent' ELSE trim(\"by\") END AS \"by\", 'proposed' AS status, array_to_string(list_sort(list_filter(evidence, lambda x: list_contains(every, x))), ',') AS evidence FROM b, cc WHERE trim(title) <> ''")
def _(spark, d):
    return _ledger(spark, d).entries().drop("batch").withColumn("evidence", F.array_join("evidence", ","))


_ALIAS = "regexp_replace(regexp_replace(lower(trim(d)), '[^\\p{L}\\p{N}/._-]+', ':', 'g'), '^:|:$', '', 'g')"


@query("r22_project_contexts", f"""WITH {_LEDGER}, own AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY us DESC, id) AS n FROM ev WHERE project IN (SELECT project FROM pr WHERE trim(title) <> '') QUALIFY n <= 18),
h AS (SELECT project, count(*) AS n, max(us) AS last_us, round(avg(confidence), 6) AS confidence, coalesce(arg_min(next_steps[1], n) FILTER (len(next_steps) > 0), 'Continue recent ' || project || ' work.') AS goal FROM own GROUP BY project),
k AS (SELECT project, {_ALIAS} AS key, min((n, p)) AS o FROM (SELECT project, n, unnest(decisions) AS d, generate_subscripts(decisions, 1) AS p FROM own) GROUP BY ALL),
m AS (SELECT project, string_agg('decision:' || key, '|' ORDER BY o) AS decisions FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY project ORDER BY o) <= 6) GROUP BY project),
f AS (SELECT project, string_agg(f || ' x' || c, '|' ORDER BY c DESC, f) AS files FROM (SELECT project, f, count(*) AS c FROM (SELECT project, unnest(files) AS f FROM own) GROUP BY ALL) GROUP BY project)
SELECT project, n, last_us, confidence, goal, 'Recent ' || project || ' working state compiled from ' || n || ' activity event(s).' AS summary, coalesce(decisions, '') AS decisions, coalesce(files, '') AS files FROM h LEFT JOIN m USING (project) LEFT JOIN f USING (project)""")
def _(spark, d):
    return _ledger(spark, d).contexts().withColumns({c: F.array_join(c, "|") for c in ("decisions", "files")})


@query("z15_change_deltas", """WITH x AS (SELECT event_id AS id, epoch_us(ts) AS us, event_type AS title, props AS summary, ['user ' || (user_id % 9), 'kind ' || event_type] AS entities, CASE WHEN event_type IN ('error', 'click') THEN ['failed ' || (user_id % 4)] ELSE [] END AS errors FROM events ORDER BY us DESC, id LIMIT 24),
cuts AS (SELECT (SELECT us FROM x ORDER BY us DESC, id OFFSET 9 LIMIT 1) AS told, (SELECT us FROM x ORDER BY us DESC, id OFFSET 3 LIMIT 1) AS own),
s AS (SELECT CAST(c_custkey AS VARCHAR) AS session, CASE WHEN c_custkey % 3 = 0 THEN own WHEN c_custkey % 3 = 1 THEN told ELSE 0 END AS since FROM customer, cuts),
j AS (SELECT session, since, id, us, title || ': ' || CASE WHEN length(summary) <= 96 THEN summary ELSE left(summary, 93) || '...' END AS item, entities, errors FROM s LEFT JOIN x ON us > since)
SELECT session, since, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY us DESC, id), '') AS events, coalesce(string_agg(item, '|' ORDER BY us DESC, id), '') AS items, coalesce(array_to_string(list_sort(list_distinct(flatten(list(entities)))), ','), '') AS entities, coalesce(array_to_string(list_sort(list_distinct(flatten(list(errors)))), ','), '') AS failures FROM j GROUP BY session, since""")
def _(spark, d):
    e = table(spark, d, "events")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind, u = F.col("event_type"), F.col("user_id")
    events = e.select(F.col("event_id").alias("id"), us.alias("us"), kind.alias("title"), F.col("props").alias("summary"), F.array(text("user ", u % 9), text("kind ", kind)).alias("entities"), F.when(kind.isin("error", "click"), F.array(text("failed ", u % 4))).otherwise(F.array().cast("array<string>")).alias("errors"))
    newest = [r.us for r in events.orderBy(F.desc("us"), "id").limit(10).collect()]
    c, told = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_custkey").cast("string").alias("session")), P.Subscribers(spark, new_folder(spark, "subscribers"))
    told.deltas(0, c.where("c % 3 = 1").select("session", F.lit(None).cast("long").alias("since")), events, newest[9])
    for _ in range(2):  # a repeated batch tells the same
        out = told.deltas(1, c.select("session", F.when(F.col("c") % 3 == 0, newest[3]).alias("since")), events, newest[0])
    return out.select("session", "since", F.size("events").alias("n"), F.array_join("events", ",").alias("events"), F.array_join("items", "|").alias("items"), *[F.array_join(F.array_sort(x), ",").alias(x) for x in ("entities", "failures")])
