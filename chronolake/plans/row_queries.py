"""Filters, text, url, joins, sets and table operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..functions import time as T
from ..functions import url as L
from ..operators import filters as P
from ..operators import joins as J
from ..operators import sets as U
from ..sources import tables as S
from ..sources.memory import MEMORIES as M
from ..sources.memory import dealt, latest, memories, table
from ..streaming import batch as B
from .registry import query

_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def norm_sql(c):
    return _NORM.format(c)


@query("s02_filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def _(spark, d):
    return S.scan(spark, f"{d}/lineitem.parquet", (F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R"), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("s04_point_lookups", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08)")
def _(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity = 50 AND l_tax = 0.08").select(F.col("l_orderkey").alias("id"))
    return S.by_ids(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), ids)


@query("s06_counts", "SELECT count(*) AS n, count(*) > 0 AS filled, count(DISTINCT doc_id) AS ids FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("filled"), F.countDistinct("doc_id").alias("ids"))


@query("s09_dimension_values", "SELECT DISTINCT source FROM documents WHERE trim(source) <> ''")
def _(spark, d):
    return S.dimension_values(table(spark, d, "documents"), "source")


@query("s11_migration", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_acctbal <= 5000")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return S.migrate(c.select("id", F.upper("name").alias("name")), c.where("c_acctbal > 5000").select("id", "name"))


@query("s14_upsert", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal >= 1000 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_acctbal < 1000")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = c.where("v < 1000").select("id", (F.col("v") + 1).alias("v"))
    return S.upsert(c, new, ["id"])


@query("s15_edge_upsert", "SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS edge_type, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1, 2, 3")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("edge_type"), F.col("l_quantity").alias("v"), "l_shipdate", "l_orderkey", "l_linenumber")
    return S.upsert(e.where("false"), e, ["source", "target", "edge_type"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("source", "target", "edge_type", "v")


@query("s16_insert_absent", "SELECT p_partkey AS id, p_size AS v FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size <= 25")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return S.insert_absent(p.where("v > 25"), p.withColumn("v", F.lit(0)), ["id"])


@query("s18_delete_by_age", M + "SELECT count(*) AS deleted FROM m, clock WHERE ts < now - INTERVAL 14 DAY")
def _(spark, d):
    m = memories(spark, d)
    return S.delete(m, T.age_hours(F.col("ts"), latest(m)) > 14 * 24)[1]


@query("s19_cascade", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <= 6")
def _(spark, d):
    c = table(spark, d, "conversations")
    gone = c.groupBy(F.col("conv_id").alias("id")).count().where("count > 6")
    return S.cascade(c, gone, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("s20_updates", M + "SELECT id, round(CASE WHEN app = 'click' THEN value * 0.5 ELSE value END, 4) AS value FROM m")
def _(spark, d):
    m = memories(spark, d).select("id", "app", "value")
    changes = m.where("app = 'click'").select("id", (F.col("value") * 0.5).alias("value"))
    return S.updated(m, changes, "id", ["value"]).select("id", F.round("value", 4).alias("value"))


@query("f01_conjunction", M + "SELECT id FROM m, clock WHERE ts >= now - INTERVAL 24 HOUR AND app = 'view'")
def _(spark, d):
    m = memories(spark, d)
    return m.where(P.all_of(T.relative_filter(F.col("ts"), "24h", latest(m)), F.col("app") == "view", None)).select("id")


@query("f04_value_set", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'it''s')")
def _(spark, d):
    return table(spark, d, "part").where(S.in_set("p_brand", ["Brand#2", "Brand#17", "it's"])).select("p_partkey")


@query("f05_substring", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def _(spark, d):
    return table(spark, d, "part").where(P.matches(["p_name", "p_brand", "p_type"], "RING")).select("p_partkey")


@query("f07_session_or_project", M + "SELECT id FROM m WHERE (session = '8' OR project = 'p3') AND id <> 0 ORDER BY us DESC, id LIMIT 40")
def _(spark, d):
    return U.newest(memories(spark, d).where(((F.col("session") == "8") | (F.col("project") == "p3")) & (F.col("id") != 0)), 40).select("id")


@query("f10_app_blocklist", "SELECT event_id AS id FROM events WHERE NOT (event_type LIKE '%err%' OR 'purchase page' LIKE '%' || event_type || '%')")
def _(spark, d):
    return memories(spark, d).where(~P.blocked_app(F.col("app"), ["ERR", "purchase page"])).select("id")


_DOM = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"


@query("f11_context_blocklist", f"WITH x AS (SELECT page_id, lower(url) AS u, {_DOM} AS h FROM pages) SELECT page_id, (u LIKE '%example.net%' OR h = 'example.net' OR h LIKE '%.example.net') AS blocked FROM x")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.blocked_context(F.lit(""), F.col("url"), ["example.net"]).alias("blocked"))


@query("f14_safety_gate", """SELECT doc_id, CASE WHEN lower(source) LIKE '%src7%' THEN 'skip_storage' WHEN regexp_matches(lower(coalesce(text, '')), 'api_key|apikey|secret_key|private_key|access_token|password:|passwd:|token:|-----begin rsa|-----begin ec|ghp_|sk-|xoxb-') THEN 'redact' ELSE 'allow' END AS decision FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.safety_gate(F.col("source"), F.lit(""), F.lit(""), F.col("text"), ["SRC7"]).alias("decision"))


@query("f15_share_class", "SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'password|bank|chase|wellsfargo|paypal|venmo|whatsapp|imessage|messenger|signal|credit card|creditcard|ssn|social security') THEN 'BLOCKED' WHEN regexp_matches(lower(coalesce(text, '')), 'salary|compensation|offer letter|personal|private') THEN 'LOCAL_ONLY' ELSE 'SHARED_ANON' END AS decision FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.share_class(F.col("text")).alias("decision"))


@query("f17_scrub", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(/Users/|/home/)[^/\s]+', '~', 'g'), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '<email>', 'g'), '[A-Za-z0-9_-]{24,}', '<token>', 'g')) AS scrubbed FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.scrub(F.col("text"))).alias("scrubbed"))


@query("f18_surface_policy")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.surface_policy(F.lit("Chrome"), F.col("url")).alias("policy"))


@query("f19_indexable", "SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', '', 'g')) >= 6")
def _(spark, d):
    return table(spark, d, "documents").where(P.indexable(F.col("text"))).select("doc_id")


@query("f20_index_url", r"SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS url FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.index_url(F.col("url"), F.lit("")).alias("url"))


@query("f23_privacy_class", "WITH t AS (SELECT doc_id, lower(concat_ws(' ', source, text)) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, 'password|secret|token') THEN 'secret' WHEN regexp_matches(t, 'bank|finance|health') THEN 'sensitive' WHEN regexp_matches(t, 'message|mail') THEN 'personal' ELSE 'project' END AS class FROM t")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.privacy_class(F.col("source"), F.col("text")).alias("class"))


_ACTIVITY_SQL = """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Reading' ELSE '' END AS explicit, doc_id % 7 = 0 AS err, doc_id % 2 = 0 AS cmd,
    doc_id % 5 AS dec, doc_id % 3 AS nxt, doc_id % 4 AS files, coalesce(text, '') AS context, doc_id % 6 = 0 AS linked, lower(concat_ws(' ', source, text)) AS t FROM documents)
SELECT doc_id, CASE WHEN explicit <> '' THEN lower(explicit) WHEN err AND cmd THEN 'debugging' WHEN dec >= 1 AND nxt >= 2 THEN 'implementation planning'
    WHEN files >= 2 AND dec = 0 THEN 'refactor review' WHEN dec = 2 THEN 'system design' WHEN nxt >= 1 AND linked THEN 'architecture analysis'
    WHEN length(context) > 800 AND NOT err AND NOT cmd THEN 'instruction writing' WHEN err OR regexp_matches(t, 'error|failed') THEN 'debugging'
    WHEN files > 0 THEN 'coding' WHEN dec > 0 OR regexp_matches(t, 'decision|tradeoff') THEN 'planning' WHEN regexp_matches(t, 'test|assert|validation') THEN 'testing_workflow'
    WHEN nxt > 0 OR regexp_matches(t, 'todo|next step') THEN 'organizing_information' WHEN linked THEN 'researching' ELSE 'unknown' END AS activity FROM r"""


@query("f24_activity_type", _ACTIVITY_SQL)
def _(spark, d):
    i = F.col("doc_id")
    some = lambda n, x: F.array_repeat(F.lit(x), n.cast("int"))
    decisions = F.when(i % 5 == 2, F.array(F.lit("use it"), F.lit(" Designed twice"))).otherwise(some(i % 5, "keep the plan"))
    activity = P.activity_type(F.when(i % 13 == 0, "Reading").otherwise(""), some((i % 7 == 0).cast("int"), "e"), some((i % 2 == 0).cast("int"), "make"), decisions, some(i % 3, "go on"), some(i % 4, "a.py"), F.col("text"), F.when(i % 6 == 0, "https://e.org"), F.concat_ws(" ", "source", "text"))
    return table(spark, d, "documents").select("doc_id", activity.alias("activity"))


_ACTION_URLS = ["", "https://x.zoom.us/j", "https://slack.com/a", "https://g.org/pull/7", "https://docs.google.com/d", "https://linear.app/i", "https://arxiv.org/abs", "https://e.org"]
_ACTION_TITLES = ["", "Inbox (3)", "Code Review", "debug run", "PRD draft", "Roadmap", "research notes", "home", "Zoom"]
_ACTIVITIES = ["", "Development", "reading", "docs", "design", "team meeting", "other"]
_ACTION_SQL = f"""WITH r AS (SELECT event_id AS id, {_ACTION_URLS}[event_id % 8 + 1] AS url, lower({_ACTION_TITLES}[event_id % 9 + 1] || ' ' || event_type) AS title, lower({_ACTIVITIES}[event_id % 7 + 1]) AS activity, event_id % 5 = 0 AS code FROM events)
SELECT id, CASE WHEN contains(activity, 'meeting') OR contains(url, 'zoom') OR contains(title, 'zoom') THEN 'meeting' WHEN regexp_matches(url, 'mail\\.google|slack\\.com|discord\\.com') OR contains(title, 'inbox') THEN 'communication'
    WHEN contains(url, '/pull/') OR regexp_matches(title, 'pull request|code review') THEN 'reviewing' WHEN code OR regexp_matches(title, 'debug|compiler error') THEN 'coding'
    WHEN regexp_matches(url, 'notion\\.|docs\\.google') OR regexp_matches(title, 'design doc|prd') THEN 'writing' WHEN regexp_matches(url, 'linear\\.app|jira') OR regexp_matches(title, 'roadmap|sprint planning') THEN 'planning'
    WHEN regexp_matches(url, 'arxiv\\.org|wikipedia\\.org') OR contains(title, 'research') THEN 'research' WHEN activity = 'development' THEN 'coding' WHEN activity = 'reading' THEN 'research' WHEN activity = 'docs' THEN 'writing' WHEN activity = 'design' THEN 'planning' ELSE 'other' END AS action FROM r"""


@query("f25_action_class", _ACTION_SQL.replace("\\\\", "\\"))
def _(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))
    files = F.when(F.col("id") % 5 == 0, F.array(F.lit("notes.md"), F.lit("src/Main.RS")))
    return memories(spark, d).select("id", P.action_class(pick(_ACTION_URLS), pick(_ACTION_TITLES), F.col("app"), pick(_ACTIVITIES), files).alias("action"))


_OUTCOME_SQL = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 31 = 0 AS failed, l_partkey % 17 = 0 AS unavailable, CASE WHEN l_partkey % 2 = 0 THEN l_tax END AS grounding, l_suppkey % 19 = 0 AS polluted,
    l_suppkey % 23 IN (1, 2, 3) AS fluff, l_partkey % 29 = 0 AS weak, l_quantity / 50 AS specificity, l_discount * 10 AS intent, l_tax * 12.5 AS usefulness, l_linenumber / 7 AS noise, l_returnflag = 'R' AS marked, l_linestatus = 'O' AS related, l_discount * 8 AS evidence FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN failed THEN 'visual_semantics_failed' WHEN unavailable AND coalesce(grounding, evidence) <= 0 THEN 'quarantine_low_grounding' WHEN polluted THEN 'quarantine_polluted_context'
    WHEN fluff THEN 'quarantine_fluff_insight' WHEN weak THEN 'low_quality_evidence' WHEN specificity >= 0.6 AND intent >= 0.55 AND usefulness >= 0.6 AND noise <= 0.5 THEN 'primary_memory_card'
    WHEN marked AND specificity < 0.6 THEN 'merge_into_existing_memory' WHEN related AND usefulness < 0.35 AND evidence < 0.5 THEN 'discard_duplicate' WHEN usefulness >= 0.45 THEN 'enriched_memory_card'
    WHEN evidence >= 0.45 THEN 'low_quality_evidence' ELSE 'defer_until_more_context' END AS outcome FROM r"""


@query("f26_storage_outcome", _OUTCOME_SQL)
def _(spark, d):
    part, supp, useful = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_tax") * 12.5
    insight = F.when(supp % 23 == 1, "shot 2024-05-06.png").when(supp % 23 == 2, "Captured recent activity in Editor").when(supp % 23 == 3, "Editor: editor open").otherwise("Editor was used to fix the parser")
    r = {
        "visual_failed": part % 31 == 0, "unavailable": part % 17 == 0, "grounding": F.when(part % 2 == 0, F.col("l_tax")), "weak_visual": part % 29 == 0, "related": F.col("l_linestatus") == "O",
        "context": F.when(supp % 19 == 0, "a line\n  Reopen: notes").otherwise("a line"), "insight": insight, "app": F.lit("Editor"), "fingerprint": F.when(F.col("l_returnflag") == "R", "f:1").otherwise(" "),
        "specificity": F.col("l_quantity") / 50, "intent": F.col("l_discount") * 10, "usefulness": useful, "noise": F.col("l_linenumber") / 7, "retrieval": useful, "evidence": F.col("l_discount") * 8,
    }
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.storage_outcome(r).alias("outcome"))


@query("f12_own_app", "SELECT p_partkey, starts_with(p_name, 'cold') AND NOT contains(lower(p_type), 'promo') OR p_size % 5 IN (0, 1, 2, 3) AS own FROM part")
def _(spark, d):
    app = F.concat(F.lit(" "), F.initcap("p_name"), F.when(F.lower("p_type").contains("promo"), " Meeting").otherwise(""))
    bundle = F.element_at(F.array(*[F.lit(x) for x in ("com.cold", "COM.cold.helper", "org.cold", "a.cold.b", "com.coldest")]), F.col("p_size") % 5 + 1)
    return table(spark, d, "part").select("p_partkey", P.own_app(app, bundle, "cold").alias("own"))


@query("f13_sensitive_context", "SELECT page_id, regexp_matches(lower(url || CASE page_id % 4 WHEN 0 THEN '/login' WHEN 1 THEN '/Chase.com' ELSE '' END), '" + "|".join(w.replace(".", "[.]") for w in P.SENSITIVE) + "') OR page_id % 6 = 0 AS sensitive FROM pages")
def _(spark, d):
    url = F.concat("url", F.when(F.col("page_id") % 4 == 0, "/login").when(F.col("page_id") % 4 == 1, "/Chase.com").otherwise(""))
    return table(spark, d, "pages").select("page_id", P.sensitive_context(F.when(F.col("page_id") % 6 == 0, "Online Banking"), url).alias("sensitive"))


@query("f16_policy_gate", "SELECT c_custkey, c_acctbal > 0 AND CASE c_nationkey % 4 WHEN 1 THEN true WHEN 2 THEN c_mktsegment = 'BUILDING' ELSE false END AS shared FROM customer")
def _(spark, d):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("disabled", "members", "opt_in", "unknown")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", P.policy_gate(mode, F.when(F.col("c_acctbal") > 0, "SHARED_ANON").otherwise("LOCAL_ONLY"), F.col("c_mktsegment") == "BUILDING").alias("shared"))


@query("f21_skips", "SELECT p_partkey, p_size / 50 > 0.97 AS noisy, p_size / 50 > 0.58 AND (p_partkey % 100) / 100 < 0.18 AS nav_heavy FROM part")
def _(spark, d):
    share = F.col("p_size") / 50
    return table(spark, d, "part").select("p_partkey", P.too_noisy(share).alias("noisy"), P.nav_heavy(share, (F.col("p_partkey") % 100) / 100).alias("nav_heavy"))


@query("j16_children", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(spark, d):
    parents = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return J.children(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", parents)


@query("f31_back_filled", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS v, 'en' AS lang FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return P.back_filled(c, {"v": F.lit(0.0), "lang": F.lit("en")})


@query("s05_ids_of_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def _(spark, d):
    return S.scan(spark, f"{d}/orders.parquet", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000), ["o_orderkey"]).withColumnRenamed("o_orderkey", "id")


@query("t05_trimmed", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS short FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.trim_to(F.col("text"), 80).alias("short"))


_TURN_WORDS = f"WITH x AS (SELECT conv_id, turn, list_filter(string_split({norm_sql('text')}, ' '), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL), v AS (SELECT DISTINCT unnest(w) AS word FROM x)"


def turn_words(spark, d):
    return table(spark, d, "conversations").where("text is not null").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()


@query("t06_word_pieces", _TURN_WORDS + "SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE left(word, length(word) // 2) || substr(word, length(word) // 2 + 2) END AS shorter, coalesce(array_to_string(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)), ' '), '') AS grams FROM v")
def _(spark, d):
    word = F.col("word")
    return turn_words(spark, d).select("word", X.drop_middle(word).alias("shorter"), F.array_join(X.char_ngrams(word, 3), " ").alias("grams"))


@query("t07_singular", _TURN_WORDS + "SELECT word, CASE WHEN strlen(word) > 4 AND word LIKE '%ies' THEN left(word, length(word) - 3) || 'y' WHEN strlen(word) > 3 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS one FROM v")
def _(spark, d):
    return turn_words(spark, d).select("word", X.singular(F.col("word")).alias("one"))


@query("l10_stems", _TURN_WORDS + """SELECT word, CASE WHEN strlen(word) > 4 AND word LIKE '%ies' THEN left(word, length(word) - 3) || 'y' WHEN strlen(word) > 5 AND word LIKE '%ing' THEN left(word, length(word) - 3)
WHEN strlen(word) > 4 AND (word LIKE '%ed' OR word LIKE '%es') THEN left(word, length(word) - 2) WHEN strlen(word) > 3 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS stem FROM v""")
def _(spark, d):
    return turn_words(spark, d).select("word", X.stem(F.col("word")).alias("stem"))


@query("w15_bigrams", _TURN_WORDS + "SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))), '|'), '') AS pairs FROM x")
def _(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(X.bigrams(X.words(F.col("text")))), "|").alias("pairs"))


@query("l26_entity_overlap", r"""WITH x AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), e AS (
SELECT conv_id, turn, before, list_distinct(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: strlen(t) > 2),
  lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: strlen(t) > 2 AND regexp_matches(t, '^\p{Lu}')), lambda t: lower(t))) AS names FROM x WHERE text IS NOT NULL AND before IS NOT NULL)
SELECT conv_id, turn, len(names) AS names, len(list_filter(names, lambda n: contains(lower(before), n))) AS shared FROM e""")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("text is not null AND before is not null")
    names = F.size(X.named_entities(F.col("text"))).cast("long")
    return c.select("conv_id", "turn", names.alias("names"), X.named_entity_overlap(F.col("text"), F.col("before")).cast("long").alias("shared"))


_DEBUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("f27_quality_issues", f"""WITH r AS (SELECT p_partkey AS id, trim(repeat(p_name || ', ', p_size % 9)) || CASE WHEN p_partkey % 7 = 0 THEN ' some ACTIVITY' ELSE '' END AS context, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'buy' END AS intent, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS project,
  CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 5 = 1 THEN '' ELSE p_type END AS topic, p_partkey % 4 = 0 AS bare, (p_size % 10) / 10 AS usefulness, (p_partkey % 9) / 9 AS noise, CASE WHEN p_partkey % 6 < 3 THEN 'primary_memory_card' ELSE 'low_quality_evidence' END AS outcome,
  p_size > 20 AS good, p_partkey % 11 AS weak, CASE WHEN p_partkey % 8 < 4 THEN p_type || ' * ' || repeat(p_name || '-', 6) ELSE p_name END AS embedding_text, p_type || '  ' || repeat(p_name || ' ', 6) AS text FROM part),
f AS (SELECT id, list_filter([CASE WHEN {_DEBUG.format('context')} = '' OR len(string_split({_DEBUG.format('context')}, ' ')) < 10 OR contains({_DEBUG.format('context')}, 'some activity') THEN 'vague_memory_context' END, CASE WHEN trim(intent) = '' THEN 'missing_intent' END,
  CASE WHEN project = '' AND topic IN ('', 'unknown') THEN 'missing_project_or_topic' END, CASE WHEN bare THEN 'missing_entities' END, CASE WHEN usefulness < 0.6 THEN 'low_agent_usefulness' END, CASE WHEN noise > 0.5 THEN 'high_ocr_noise' END,
  CASE WHEN outcome = 'primary_memory_card' AND NOT good THEN 'primary_should_be_low_quality_evidence' END, CASE WHEN weak > 8 THEN 'graph_events_with_weak_evidence' END,
  CASE WHEN length({_DEBUG.format('embedding_text')}) > 60 AND starts_with({_DEBUG.format('embedding_text')}, left({_DEBUG.format('text')}, 42)) THEN 'embedding_text_dominated_by_raw_ocr' END], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT id, array_to_string(issues, ',') AS issues FROM f WHERE len(issues) > 0""")
def _(spark, d):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    times = lambda c, mark, n: F.repeat(F.concat(c, F.lit(mark)), n.cast("int"))
    none = F.array().cast("array<string>")
    rows = dealt(table(spark, d, "part"), "p_partkey").select(
        k.alias("id"), F.concat(F.trim(times(name, ", ", size % 9)), F.when(k % 7 == 0, " some ACTIVITY").otherwise("")).alias("context"), F.when(k % 3 == 0, " ").otherwise("buy").alias("intent"), F.when(k % 2 == 0, "").otherwise(F.col("p_brand")).alias("project"),
        F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "").otherwise(F.col("p_type")).alias("topic"), F.when(k % 4 == 0, none).otherwise(F.array("p_brand")).alias("entities"), F.when(k % 8 == 2, F.array(name)).otherwise(none).alias("files"), ((size % 10) / 10).alias("usefulness"), ((k % 9) / 9).alias("noise"),
        F.when(k % 6 < 3, "primary_memory_card").otherwise("low_quality_evidence").alias("outcome"), F.when(k % 11 > 8, 1).otherwise(0).alias("weak_graph"), F.when(k % 8 < 4, F.concat(F.col("p_type"), F.lit(" * "), times(name, "-", F.lit(6)))).otherwise(name).alias("embedding_text"), F.concat(F.col("p_type"), F.lit("  "), times(name, " ", F.lit(6))).alias("text"), (size > 20).alias("good"),
    )
    out = P.quality_issues(rows, F.when(F.col("good"), "primary_memory_card").otherwise("low_quality_evidence"))
    return out.select("id", F.array_join("issues", ",").alias("issues"))


@query("t01_normalise", f"SELECT doc_id, md5({norm_sql('text')}) AS norm FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalise(F.col("text"))).alias("norm"))


@query("t02_normalise_ascii", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalise_ascii(F.col("text"))).alias("norm"))


@query("t03_alias_key", r"SELECT doc_id, md5(trim(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}/._-]+', ':', 'g'), ':')) AS key FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.alias_key(F.col("text"))).alias("key"))


@query("t04_words", f"SELECT doc_id, len(list_filter(string_split({norm_sql('text')}, ' '), lambda w: w <> '')) AS words, len(list_distinct(list_filter(string_split({norm_sql('text')}, ' '), lambda w: w <> ''))) AS different FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    w = X.words(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("different"))


@query("t08_symbol_ratio", "SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) = 0 THEN 1 ELSE length(regexp_replace(text, '[\\p{L}\\p{N}\\s]+', '', 'g')) / length(regexp_replace(text, '\\s+', '', 'g')) END, 6) AS symbols FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(X.symbol_ratio(F.col("text")), 6).alias("symbols"))


@query("t14_jaccard", f"""WITH x AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({norm_sql('text')}, ' '), lambda w: w <> '')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM x)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, q))) = 0 THEN 0 ELSE len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))) END, 6) AS overlap FROM p WHERE q IS NOT NULL""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("w"))
    c = c.withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q is not null")
    return c.select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("q")), 6).alias("overlap"))


@query("t15_acronym", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '') AS acronym FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.acronym(F.col("p_name")).alias("acronym"))


@query("t22_mentions", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(https?://[^\s)\]>\x22'']+)', 1))) AS urls, len(list_distinct(regexp_extract_all(text, '(#\d+|[A-Z]{2,10}-\d+)\b', 1))) AS issues FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    m = X.mentions(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(m["urls"]).cast("long").alias("urls"), F.size(m["issues"]).cast("long").alias("issues"))


@query("t26_token_estimate", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


@query("t_url_parts", rf"SELECT page_id, {_DOM} AS domain, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", L.domain(u).alias("domain"), L.host_simple(u).alias("host"), L.canonical(u).alias("canonical"))


@query("t_session_key", M + "SELECT id, lower(app) || ':' || project || ':' || CAST(us // 1800000000 AS VARCHAR) AS key FROM m")
def _(spark, d):
    return memories(spark, d).select("id", H.session_key(F.col("app"), F.col("project"), F.floor(F.col("us") / 1000)).alias("key"))


@query("j02_events_in_window", M + ", o AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT id, c_mktsegment FROM m, clock, o WHERE c_custkey = CAST(session AS BIGINT) AND ts >= now - INTERVAL 2 DAY AND app = 'click'")
def _(spark, d):
    m = memories(spark, d)
    now = latest(m)
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session"), "c_mktsegment")
    return m.where(T.relative_filter(F.col("ts"), None, now) & (T.age_hours(F.col("ts"), now) <= 48) & (F.col("app") == "click")).join(c, "session").select("id", "c_mktsegment")


@query("j05_interval", """WITH s AS (SELECT CAST(session AS BIGINT) AS seg, min(us) AS lo, min(us) + 7200000000 AS hi FROM (SELECT user_id AS session, epoch_us(ts) AS us FROM events) GROUP BY 1)
SELECT seg, count(*) AS n FROM s JOIN events ON epoch_us(ts) BETWEEN lo AND hi GROUP BY seg""")
def _(spark, d):
    m = memories(spark, d)
    s = m.groupBy("session").agg(F.min("us").alias("lo")).select(F.col("session").cast("long").alias("seg"), "lo", (F.col("lo") + 7_200_000_000).alias("hi"))
    return J.interval_join(m.select("id", "us"), "us", s, "lo", "hi", 3_600_000_000).groupBy("seg").agg(F.count("*").alias("n"))


@query("j06_two_hop", "SELECT DISTINCT c_custkey, l_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 3")
def _(spark, d):
    c = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return c.join(o, "c_custkey").join(li, "o_orderkey").select("c_custkey", "l_suppkey").distinct()


def _edges(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("target"))


@query("j08_both_ends", "WITH i AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) SELECT c_custkey AS source, CAST(c_nationkey AS BIGINT) AS target FROM customer WHERE c_custkey IN (SELECT id FROM i) AND c_nationkey IN (SELECT id FROM i)")
def _(spark, d):
    return J.both_ends(_edges(spark, d), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))).select("source", "target")


@query("j09_either_end", "WITH i AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000) SELECT c_custkey AS source, CAST(c_nationkey AS BIGINT) AS target FROM customer WHERE c_custkey IN (SELECT id FROM i) OR c_nationkey IN (SELECT id FROM i)")
def _(spark, d):
    return J.either_end(_edges(spark, d), table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))).select("source", "target")


@query("j13_pruned_lists", "SELECT o_custkey AS id, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS live FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def _(spark, d):
    o = table(spark, d, "orders")
    lists = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    live = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return J.pruned_lists(lists, "ids", live).where(F.size("ids") > 0).select("id", F.array_join("ids", ",").alias("live"))


@query("j14_left_default", "SELECT conv_id, turn, coalesce(CASE WHEN conv_id % 3 = 0 THEN 'T' || conv_id END, 'Meeting') AS title FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    titles = c.where("conv_id % 3 = 0").select("conv_id", F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title")).distinct()
    return c.join(titles, "conv_id", "left").withColumn("title", F.coalesce("title", F.lit("Meeting")))


@query("j15_parent_chain", "WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0), r(id, ancestor, hops) AS (SELECT id, id, 0 FROM p UNION ALL SELECT r.id, p.parent, hops + 1 FROM r JOIN p ON p.id = r.ancestor WHERE hops < 4) SELECT id, ancestor, CAST(hops AS INTEGER) AS hops FROM r")
def _(spark, d):
    p = table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).cast("long").alias("parent"))
    return J.parent_chain(p, p.select("id"), 4)


@query("j17_neighbours", """WITH x AS (SELECT event_id AS id, user_id AS k, epoch_us(ts) AS us FROM events), p AS (SELECT a.id, b.id AS neighbour, abs(a.us - b.us) AS gap FROM x a JOIN x b ON a.k = b.k AND a.id <> b.id AND abs(a.us - b.us) <= 86400000000)
SELECT id, neighbour, gap, CAST(row_number() OVER (PARTITION BY id ORDER BY gap, neighbour) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, neighbour) <= 2""")
def _(spark, d):
    return J.neighbours(memories(spark, d).select("id", "session", "us"), "session", "us", 86_400_000_000, 2)


@query("j18_alias_resolution", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    alias = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(alias, "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")


@query("j19_redirects", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 3 ELSE o_custkey END AS o_custkey FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    moves = table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 3).alias("new"))
    return J.redirected(o, "o_custkey", moves)


@query("j21_as_of", M + ", c AS (SELECT * FROM m WHERE app = 'click'), v AS (SELECT session, us, value FROM m WHERE app = 'view') SELECT c.id, v.value AS asof_value FROM c ASOF LEFT JOIN v ON c.session = v.session AND c.us >= v.us")
def _(spark, d):
    m = memories(spark, d)
    return J.as_of(m.where("app = 'click'").select("id", "session", "us"), m.where("app = 'view'").select("session", "us", "value"), "session", "us", ["value"]).select("id", "asof_value")


@query("j22_contradictions", "WITH x AS (SELECT p_partkey AS id, p_brand AS project, p_name LIKE '%red%' AS neg FROM part) SELECT a.project, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM x a JOIN x b ON a.project = b.project AND a.neg AND NOT b.neg")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_name").contains("red").alias("neg"))
    return J.contradictions(p, F.col("neg"))


@query("j23_related", "WITH e AS (SELECT DISTINCT p_partkey AS id, p_brand AS topic, unnest(string_split(p_name, ' ')) AS entity FROM part) SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN e b ON a.entity = b.entity AND a.topic = b.topic AND a.id < b.id")
def _(spark, d):
    return J.related(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"), F.split("p_name", " ").alias("entities")))


@query("j24_nested_feedback", "SELECT o_orderkey AS run, count(l_linenumber) AS n, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_tax = 0 GROUP BY 1")
def _(spark, d):
    f = table(spark, d, "lineitem").where("l_tax = 0").groupBy(F.col("l_orderkey").alias("run")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("run")).join(f, "run", "left")
    return r.select("run", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"), F.array_join("x", ",").alias("lines")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query("j25_exclusion_reasons", """WITH x AS (SELECT doc_id AS id, source, n_chars AS score, doc_id % 3 <> 0 AS sel, lang = 'fr' AS priv FROM documents), y AS (SELECT *, CASE WHEN NOT sel THEN 'not_selected' WHEN priv THEN 'private' END AS why FROM x)
SELECT id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL, source ORDER BY score DESC, id) <= 5 THEN 'kept' ELSE 'over_cap' END) AS reason FROM y""")
def _(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("score"), "lang")
    return J.with_reasons(x, x.where("id % 3 <> 0").select("id"), F.col("lang") == "fr", 5)


@query("u01_branch_union", "WITH u AS (SELECT p_partkey AS id, p_size / 50 AS score, 'a' AS b FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, p_retailprice / 2000, 'b' FROM part WHERE p_name LIKE '%ring%') SELECT id, round(max(score), 6) AS score, round(max(score) FILTER (b = 'a'), 6) AS a, round(max(score) FILTER (b = 'b'), 6) AS b FROM u GROUP BY id")
def _(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size > 20").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))
    b = p.where("p_name like '%ring%'").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score"))
    return U.branch_union({"a": a, "b": b}).select("id", *[F.round(c, 6).alias(c) for c in ("score", "a", "b")])


@query("u03_keep_first", "SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def _(spark, d):
    return U.keep_first(table(spark, d, "part"), F.lower("p_name"), ["p_partkey"]).select("p_partkey")


@query("u04_insert_dedup", M + "SELECT id FROM m QUALIFY row_number() OVER (PARTITION BY props ORDER BY value DESC, us DESC, id) = 1")
def _(spark, d):
    return B.insert_dedup(memories(spark, d), "props", "value").select("id")


@query("u05_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return U.difference(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("u06_list_merge", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("x"))
    return g.select("l_orderkey", F.array_join(X.merge_lists(F.col("x"), F.transform("x", lambda v: F.lower(v))), ",").alias("flags"))


@query("k02_newest", M + "SELECT id FROM m ORDER BY us DESC, id LIMIT 1500")
def _(spark, d):
    return U.newest(memories(spark, d), 1500).select("id")


@query("k04_tail", M + "SELECT id, us FROM (SELECT * FROM m ORDER BY us DESC, id LIMIT 30)")
def _(spark, d):
    return U.tail_ascending(memories(spark, d), 30).select("id", "us")


@query("k09_split_top", "WITH x AS (SELECT p_partkey AS id, p_size AS w, p_brand = 'Brand#2' AS f FROM part) (SELECT id, w FROM x WHERE f ORDER BY w DESC, id LIMIT 50) UNION ALL (SELECT id, w FROM x WHERE NOT f ORDER BY w DESC, id LIMIT 50)")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("w"), "p_brand")
    return U.split_top(x, F.col("p_brand") == "Brand#2", "w", 50).select("id", "w")


_PRIORITY_SQL = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_orderkey, greatest(0, least(96, 96 - CAST(floor((epoch_us(now) - epoch_us(o_orderdate)) / 3600000000) AS BIGINT))) + 4 * least(coalesce(n, 0), 10) + 2 * least(o_custkey % 8, 6) + CASE o_orderstatus WHEN 'O' THEN 12 ELSE 0 END
    + CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 22 WHEN '2' THEN 16 WHEN '3' THEN 11 ELSE 6 END - CASE WHEN coalesce(n, 0) < 4 AND substr(o_orderpriority, 1, 1) NOT IN ('1', '2') THEN 18 ELSE 0 END - CASE WHEN o_totalprice < 50000 THEN 24 ELSE 0 END AS priority
FROM orders LEFT JOIN n ON o_orderkey = l_orderkey, c"""


@query("k10_task_priority", _PRIORITY_SQL)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    age = F.floor((T.micros(F.lit(latest(o))) - T.micros(F.col("ts"))) / 3_600_000_000)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("manual", "meeting", "memory", "other", "other")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    linked = F.coalesce("n", F.lit(0))
    score = U.task_priority(age, linked, F.col("o_custkey") % 8, F.col("o_orderstatus") == "O", kind, linked >= 4, F.col("o_totalprice") < 50000)
    return o.join(n, "o_orderkey", "left").select("o_orderkey", score.cast("long").alias("priority"))


@query("z03_sliding_dedup", M + ", p AS (SELECT id, us - lag(us) OVER (PARTITION BY session, app ORDER BY us, id) AS g FROM m) SELECT id FROM p WHERE g IS NULL OR g > 43200000000")
def _(spark, d):
    return B.sliding_dedup(memories(spark, d), ["session", "app"], 43_200).select("id")


_TUMBLING_SQL = M.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, u AS (SELECT session, us, min(id) AS id FROM m GROUP BY 1, 2), nxt AS (SELECT session, us, min(us) OVER (PARTITION BY session ORDER BY us RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM u),
g AS (SELECT session, min(us) AS us FROM m GROUP BY session UNION ALL SELECT nxt.session, nxt.next_us FROM g JOIN nxt ON g.session = nxt.session AND g.us = nxt.us WHERE next_us IS NOT NULL) SELECT u.id FROM g JOIN u USING (session, us)"""


@query("z04_tumbling_dedup", _TUMBLING_SQL)
def _(spark, d):
    return B.tumbling_dedup(memories(spark, d).select("id", "us", "session"), ["session"], 3600).select("id")


@query("z08_merged_records", M + "SELECT session, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_max(app, (us, id)) AS app, max(value) AS value FROM m GROUP BY session")
def _(spark, d):
    return B.merged(memories(spark, d), "session", scores=["value"], texts=["app"])


@query("z11_review_queue", M + "SELECT CAST(session AS BIGINT) AS id, min(us) AS us FROM m GROUP BY 1")
def _(spark, d):
    return B.review_queue(memories(spark, d).select(F.col("session").cast("long").alias("id"), "us"))


@query("r21_changes_since", M + "SELECT id FROM (SELECT * FROM m ORDER BY us DESC, id LIMIT 24), clock WHERE us > epoch_us(now) - 3600000000")
def _(spark, d):
    m = memories(spark, d)
    base = m.agg(F.max("us")).first()[0] - 3_600_000_000
    return B.changes_since(m, base).select("id")
