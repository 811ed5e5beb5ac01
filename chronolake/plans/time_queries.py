"""Statistics and sequence queries over the memory view."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import time as T
from ..functions import url as L
from ..operators import stats as S
from ..operators import windows as W
from ..sources.memory import MEMORIES as M
from ..sources.memory import latest, memories, table
from .registry import query


@query("a01_counts", M + "SELECT count(*) AS total, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS last_1h, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS last_7d FROM m, clock")
def _(spark, d):
    m = memories(spark, d)
    return S.counts(m, latest(m))


@query("a02_span", M + "SELECT min(us) AS first_us, max(us) AS last_us, round((max(us) - min(us)) / 3.6e9, 6) AS span_hours FROM m")
def _(spark, d):
    return S.span(memories(spark, d))


@query("a03_days", M + "SELECT count(DISTINCT day) AS active_days, count(*) FILTER (day = CAST(now AS DATE)) AS today FROM m, clock")
def _(spark, d):
    m = memories(spark, d)
    return S.days(m, latest(m))


@query("a04_hour_histogram", M + "SELECT CAST(h AS INTEGER) AS hour, count(id) AS n FROM range(24) r(h) LEFT JOIN m ON hour(ts) = h GROUP BY h")
def _(spark, d):
    return S.dense(spark, memories(spark, d), F.hour("ts"), 24, "hour")


@query("a05_weekday_histogram", M + "SELECT CAST(w AS INTEGER) AS weekday, count(id) AS n FROM range(7) r(w) LEFT JOIN m ON isodow(ts) - 1 = w GROUP BY w")
def _(spark, d):
    return S.dense(spark, memories(spark, d), F.weekday("ts"), 7, "weekday")


@query("a06_dayparts", M + "SELECT CASE WHEN hour(ts) BETWEEN 4 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 15 THEN 'Afternoon' WHEN hour(ts) BETWEEN 16 AND 19 THEN 'Evening' ELSE 'Night' END AS part, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return S.dayparts(memories(spark, d))


@query("a07_busiest_hour", M + "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, hour DESC LIMIT 1")
def _(spark, d):
    return S.busiest_hour(memories(spark, d))


@query("a08_extreme_days", M + ", g AS (SELECT day, count(*) AS n FROM m GROUP BY day) SELECT (SELECT CAST(day AS VARCHAR) FROM g ORDER BY n DESC, day LIMIT 1) AS busiest, max(n) AS busiest_n, (SELECT CAST(day AS VARCHAR) FROM g ORDER BY n, day LIMIT 1) AS quietest, min(n) AS quietest_n FROM g")
def _(spark, d):
    return S.extreme_days(memories(spark, d))


@query("a09_top_apps", M + "SELECT app AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM m) * 100, 4) AS share_pct FROM m GROUP BY app ORDER BY n DESC, app LIMIT 10")
def _(spark, d):
    return S.top_values(memories(spark, d), F.col("app"))


_DOMAIN = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"


@query("a10_top_domains", f"WITH g AS (SELECT {_DOMAIN} AS value, count(*) AS n FROM pages GROUP BY 1) SELECT value, n, round(n / (SELECT sum(n) FROM g WHERE value <> '') * 100, 4) AS share_pct FROM g WHERE value <> '' ORDER BY n DESC, value LIMIT 10")
def _(spark, d):
    return S.top_values(table(spark, d, "pages"), L.domain(F.col("url")), blank=None)


@query("a11_distinct", M + "SELECT count(DISTINCT app) AS app, count(DISTINCT session) AS session, count(DISTINCT project) AS project FROM m")
def _(spark, d):
    return S.distinct_counts(memories(spark, d), ["app", "session", "project"])


@query("a12_filled", "SELECT count(nullif(trim(text), '')) AS text, count(nullif(trim(source), '')) AS source, count(nullif(trim(lang), '')) AS lang FROM documents")
def _(spark, d):
    return S.filled_counts(table(spark, d, "documents"), ["text", "source", "lang"])


@query("a13_classes", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS other FROM events")
def _(spark, d):
    return S.class_counts(memories(spark, d), F.col("app"), ["click", "view", "error"])


@query("a14_quality", "WITH x AS (SELECT greatest(value / 100 - 0.05, 0) AS c, greatest(CAST(user_id % 10 AS DOUBLE) / 10, 0) AS n FROM events) SELECT round(avg(c), 6) AS mean_confidence, round(avg(n), 6) AS mean_noise, count(*) FILTER (c > 0 AND c < 0.55) AS low_confidence, count(*) FILTER (n >= 0.40) AS high_noise FROM x")
def _(spark, d):
    m = memories(spark, d).select((F.col("value") / 100 - 0.05).alias("c"), ((F.col("session").cast("long") % 10) / 10).alias("n"))
    return S.quality(m, "c", "n")


@query("a15_switches", M + ", p AS (SELECT app, lag(app) OVER (ORDER BY us, id) AS q, us FROM m) SELECT count(*) FILTER (q IS NOT NULL AND q <> app) AS switches, round(count(*) FILTER (q IS NOT NULL AND q <> app) / ((max(us) - min(us)) / 3.6e9), 6) AS per_hour FROM p")
def _(spark, d):
    return W.switches(memories(spark, d))


@query("a16_gaps", M + ", p AS (SELECT us - lag(us) OVER (ORDER BY us, id) AS gap FROM m) SELECT round(avg(CASE WHEN gap > 0 THEN gap / 6e7 END), 6) AS mean_gap_min, CAST(floor(max(gap) / 6e7) AS BIGINT) AS longest_gap_min FROM p")
def _(spark, d):
    return W.gap_stats(memories(spark, d))


@query("a17_rates", M + "SELECT round(count(*) / count(DISTINCT day), 6) AS per_active_day, round(count(*) / ((max(us) - min(us)) / 3.6e9), 6) AS per_hour FROM m")
def _(spark, d):
    return S.rates(memories(spark, d))


_STREAKS = M + """, x AS (SELECT DISTINCT session, day FROM m), i AS (SELECT session, day, day - CAST(row_number() OVER (PARTITION BY session ORDER BY day) AS INTEGER) AS island FROM x),
r AS (SELECT session, island, count(*) AS n, max(day) AS last FROM i GROUP BY ALL) SELECT session, max(n) AS longest, arg_max(n, last) AS current FROM r GROUP BY session"""


@query("a18_streaks", _STREAKS)
def _(spark, d):
    return W.streaks(memories(spark, d), "session")


@query("a19_active_minutes", M + ", p AS (SELECT app, least((us - lag(us) OVER (PARTITION BY app ORDER BY us, id)) / 1e6, 300.0) AS gap FROM m) SELECT app, round(greatest(coalesce(sum(gap), 0), 30) / 60, 4) AS minutes FROM p GROUP BY app")
def _(spark, d):
    return W.active_minutes(memories(spark, d))


@query(
    "a20_clusters",
    M
    + """, g AS (SELECT day, app, project, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day, app ORDER BY last_us - first_us DESC, project) AS k FROM g)
SELECT CAST(day AS VARCHAR) AS day, app, CASE WHEN k <= 4 THEN project ELSE '(rest)' END AS label, CAST(sum(n) AS BIGINT) AS n, min(first_us) AS first_us, max(last_us) AS last_us FROM r GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return S.clusters(memories(spark, d))


@query("a21_projects", M + "SELECT project, count(*) AS n, max(us) AS last_us, arg_max(app, us) AS latest FROM m GROUP BY project")
def _(spark, d):
    return S.projects(memories(spark, d))


@query("a22_url_frequency", "WITH u AS (SELECT url FROM pages UNION ALL SELECT regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') FROM pages) SELECT url, count(*) AS n FROM u WHERE trim(url) <> '' GROUP BY url ORDER BY n DESC, url LIMIT 50")
def _(spark, d):
    p = table(spark, d, "pages")
    both = p.select("url").union(p.select(L.canonical(F.col("url"))))
    return both.where("trim(url) <> ''").groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(50)


@query("a23_item_frequency", "SELECT w AS item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 80")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(80)


def _timeline(bucket):
    return M + f"SELECT {bucket} AS bucket, min(us) AS start_us, max(us) AS end_us, count(*) AS n, arg_max(app, us) AS last_app, string_agg(DISTINCT app, ',' ORDER BY app) AS apps, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM m GROUP BY 1"


@query("a24_timeline_hours", _timeline("CAST(us // 3600000000 AS BIGINT)"))
def _(spark, d):
    return S.timeline(memories(spark, d), F.floor(F.col("us") / 3.6e9).cast("long"))


@query("a24_timeline_projects", _timeline("project"))
def _(spark, d):
    return S.timeline(memories(spark, d), F.col("project"))


@query("a24_timeline_sessions", _timeline("session"))
def _(spark, d):
    return S.timeline(memories(spark, d), F.col("session"))


@query("a26_relevant_items", M + "SELECT json_extract_string(props, '$.k') AS item, count(*) AS n, bool_or(day = CAST(now AS DATE)) AS active FROM m, clock GROUP BY 1 ORDER BY active DESC, n DESC, item LIMIT 8")
def _(spark, d):
    m = memories(spark, d)
    today = F.lit(latest(m).date())
    return m.groupBy(F.get_json_object("props", "$.k").alias("item")).agg(F.count("*").alias("n"), F.bool_or(F.col("day") == today).alias("active")).orderBy(F.desc("active"), F.desc("n"), "item").limit(8)


@query("a27_recent_errors", M + ", r AS (SELECT id, us, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY us DESC, id) AS n FROM m WHERE app = 'error') SELECT id, us, k FROM r WHERE n = 1 ORDER BY us DESC, id LIMIT 6")
def _(spark, d):
    e = memories(spark, d).where("app = 'error'").select("id", "us", F.get_json_object("props", "$.k").alias("k"))
    return W.best_per_key(e, ["k"], [F.desc("us"), F.col("id")]).orderBy(F.desc("us"), "id").limit(6)


@query("a31_card_scores", M + ", r AS (SELECT session, value / 1000 AS s, row_number() OVER (PARTITION BY session ORDER BY value / 1000 DESC, id) AS k FROM m) SELECT session, round(least(1.0, sum(s / k) / sum(1.0 / k) + 0.04 * count(*)), 6) AS card_score, count(*) AS n FROM r GROUP BY session")
def _(spark, d):
    return S.card_scores(memories(spark, d).withColumn("score", F.col("value") / 1000), "session", "score")


@query("a32_session_duration", M + "SELECT session, round((max(us) - min(us)) / 6e7, 6) AS minutes, round(avg(value), 6) AS mean_value FROM m GROUP BY session")
def _(spark, d):
    return memories(spark, d).groupBy("session").agg(F.round((F.max("us") - F.min("us")) / 6e7, 6).alias("minutes"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("a34_facets", M + "SELECT string_agg(DISTINCT app, ',' ORDER BY app) AS types, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, min(value) AS low, max(value) AS high FROM m")
def _(spark, d):
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return memories(spark, d).agg(join("app").alias("types"), join("project").alias("projects"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("a36_telemetry", M + "SELECT app, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, round(avg(value), 6) AS mean FROM m GROUP BY app")
def _(spark, d):
    return S.telemetry(memories(spark, d), "app", "value")


@query("w16_ewma", M + ", s AS (SELECT session, list(value ORDER BY us, id) AS v FROM m GROUP BY session) SELECT session, round(list_reduce(v, lambda a, x: a + 0.125 * (x - a)), 6) AS ewma FROM s")
def _(spark, d):
    return W.ewma(memories(spark, d), "session", "value")


@query("w04_sessions", M + """, p AS (SELECT *, lag(us) OVER o AS pu, lag(app) OVER o AS pa, lag(project) OVER o AS pp FROM m WINDOW o AS (ORDER BY us, id)),
s AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu > 1200000000 OR pa <> app OR pp <> project THEN 1 ELSE 0 END) OVER (ORDER BY us, id) AS k FROM p)
SELECT CAST(k AS BIGINT) AS session_no, count(*) AS n, min(us) AS start_us, max(us) AS end_us, any_value(app) AS app FROM s GROUP BY k""")
def _(spark, d):
    s = W.sessions(memories(spark, d).select("id", "us", "day", "app", "project"), ["app", "project"])
    return s.groupBy("session_no").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("app").alias("app"))


_ANCHOR_SQL = M.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + """, u AS (SELECT DISTINCT app, us FROM m), nxt AS (SELECT app, us, max(us) OVER (PARTITION BY app ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 300000001 PRECEDING) AS next_us FROM u),
g AS (SELECT app, max(us) AS us FROM m GROUP BY app UNION ALL SELECT nxt.app, nxt.next_us FROM g JOIN nxt ON g.app = nxt.app AND g.us = nxt.us WHERE next_us IS NOT NULL),
n AS (SELECT app, count(*) AS n FROM m GROUP BY app) SELECT app, count(*) AS groups, n FROM g JOIN n USING (app) GROUP BY app, n"""


@query("w05_anchored_groups", _ANCHOR_SQL)
def _(spark, d):
    g = W.anchored_groups(memories(spark, d).select("id", "us", "app"), "app", 5)
    return g.groupBy("app").agg(F.countDistinct("part", "group_no").alias("groups"), F.count("*").alias("n"))


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: strlen(w) > 2))"
_ALIKE = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query("w06_split_groups", f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT *, CASE WHEN turn % 3 = 0 THEN {_TOKENS.format("role || ' ' || text")} ELSE ['topic ' || (conv_id % 2 + turn // 4), role] END AS e, {_TOKENS.format('text')} AS w FROM c),
l AS (SELECT *, lag(e) OVER o AS pe, lag(w) OVER o AS pw FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, text))
SELECT conv_id, turn, CAST(1 + sum(CASE WHEN pe IS NOT NULL AND {_ALIKE.format('e', 'pe')} < 0.35 AND {_ALIKE.format('w', 'pw')} < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM l""")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")])
    topic = F.concat(F.lit("Topic: "), (F.col("conv_id") % 2 + F.floor(F.col("turn") / 4)).cast("string"))
    rows = c.withColumns({"title": F.col("role"), "summary": F.col("text"), "entities": F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(topic, F.col("role")))})
    return W.split_groups(rows, "conv_id", ["turn", "text"]).select("conv_id", "turn", "part")


@query("w07_best_per_key", M + "SELECT session, id, value FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY value DESC, us DESC, id) = 1")
def _(spark, d):
    return W.best_per_key(memories(spark, d).select("session", "id", "value", "us"), ["session"], [F.desc("value"), F.desc("us"), F.col("id")]).drop("us")


@query("w08_session_cap", M + "SELECT session, id FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY value DESC, us DESC, id) <= 2")
def _(spark, d):
    w = Window.partitionBy("session").orderBy(F.desc("value"), F.desc("us"), "id")
    return memories(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 2").select("session", "id")


@query("w12_session_coherence", M + "SELECT id, count(*) OVER (PARTITION BY session, day) AS coherence FROM m")
def _(spark, d):
    return memories(spark, d).select("id", F.count("*").over(Window.partitionBy("session", "day")).alias("coherence"))


@query("w13_min_max", M + "SELECT id, round(CASE WHEN max(value) OVER w - min(value) OVER w > 1e-9 THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) WHEN value > 0 THEN 1 ELSE 0 END, 6) AS scaled FROM m WINDOW w AS (PARTITION BY session)")
def _(spark, d):
    return W.min_max_scaled(memories(spark, d), "value", "scaled", ["session"]).select("id", F.round("scaled", 6).alias("scaled"))


@query("w14_freshness", M + "SELECT id, round((us - min(us) OVER w) / greatest(max(us) OVER w - min(us) OVER w, 1), 6) AS freshness FROM m WINDOW w AS (PARTITION BY session)")
def _(spark, d):
    w = Window.partitionBy("session")
    return memories(spark, d).select("id", F.round((F.col("us") - F.min("us").over(w)) / F.greatest(F.max("us").over(w) - F.min("us").over(w), F.lit(1)), 6).alias("freshness"))


@query("w17_switch_alerts", M + ", r AS (SELECT id, session, list(app) OVER (PARTITION BY session ORDER BY us, id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS a FROM m) SELECT session, count(*) AS alerts FROM r WHERE len(a) >= 8 AND len(list_distinct(a)) >= 4 GROUP BY session")
def _(spark, d):
    return W.switch_alerts(memories(spark, d), "session", least_distinct=4).groupBy("session").agg(F.count("*").alias("alerts"))


@query("w18_drift", M + ", r AS (SELECT session, id, sum(CASE WHEN value < 30 THEN 1 ELSE 0 END) OVER w AS s, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY session ORDER BY us, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT session, count(*) AS drifts FROM r WHERE s = 3 AND c = 3 GROUP BY session")
def _(spark, d):
    return W.runs_of(memories(spark, d), F.col("value") < 30, "session", 3).groupBy("session").agg(F.count("*").alias("drifts"))


@query("f02_relative_filters", M + "SELECT '24h' AS name, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS n FROM m, clock UNION ALL SELECT '7d', count(*) FILTER (ts >= now - INTERVAL 7 DAY) FROM m, clock UNION ALL SELECT 'today', count(*) FILTER (day = CAST(now AS DATE)) FROM m, clock UNION ALL SELECT 'yesterday', count(*) FILTER (day = CAST(now AS DATE) - 1) FROM m, clock UNION ALL SELECT 'other', count(*) FROM m")
def _(spark, d):
    m = memories(spark, d)
    now = latest(m)
    names = ["24h", "7d", "today", "yesterday", "other"]
    one = m.agg(*[F.count_if(T.relative_filter(F.col("ts"), n, now)).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


@query("f03_range", M + "SELECT id FROM m, clock WHERE ts >= now - INTERVAL 3 DAY AND ts <= now - INTERVAL 1 DAY")
def _(spark, d):
    m = memories(spark, d)
    now = latest(m)
    return m.where(T.window(F.col("ts"), now - timedelta(days=3), now - timedelta(days=1))).select("id")


@query("t_content_hash", "WITH p AS (SELECT page_id, url, substr(html, 1, 20) AS title FROM pages) SELECT page_id, sha256(url || '|' || title || '|' || CAST(page_id * 60000 // 300000 AS VARCHAR)) AS hash FROM p")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", H.content_hash(F.col("url"), F.substring("html", 1, 20), F.col("page_id") * 60000).alias("hash"))


@query("t_decay", M + "SELECT id, round(CASE WHEN date_diff('microsecond', ts, now) / 8.64e10 <= 1 THEN 1.0 ELSE greatest(0.15, pow(0.5, date_diff('microsecond', ts, now) / 8.64e10 / 21.0)) END, 6) AS decay, round(1 / (1 + 0.03 * least(date_diff('microsecond', ts, now) / 3.6e9, 720)), 6) AS recency FROM m, clock")
def _(spark, d):
    m = memories(spark, d)
    h = T.age_hours(F.col("ts"), latest(m))
    return m.select("id", F.round(T.ebbinghaus(F.lit(1.0), h / 24), 6).alias("decay"), F.round(T.recency(h), 6).alias("recency"))
