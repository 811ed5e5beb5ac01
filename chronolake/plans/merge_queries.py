"""Merging queries over the driver's tables: continuity index, merge targets, resumable history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.checkpoints import new_folder
from ..sources.memory import table
from ..streaming import history as H
from ..streaming import merging as M
from .registry import query

_GENERIC = ", ".join(f"'{w}'" for w in M.GENERIC)


def _words(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: strlen(w) > 2 AND w NOT IN ({_GENERIC}))"


_REST = "coalesce(string_split(url, '://')[2], url)"
_HOST = f"nullif(trim(string_split({_REST}, '/')[1]), '')"
_PATH = f"list_filter(list_transform(string_split({_REST}, '/')[2:], lambda p: lower(trim(p))), lambda p: p <> '')"
_APP = "'app:' || coalesce(nullif(trim(regexp_replace(lower(app), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), ''), 'unknown')"


def _named(kind: str, least: int) -> str:
    name = f"array_to_string(({_words(kind)})[:8], '_')"
    return f"CASE WHEN strlen({name}) >= {least} THEN {_APP} || ':{kind}:' || {name} END"


_ANCHOR = f"coalesce('url:' || lower({_HOST}) || CASE WHEN len({_PATH}) > 0 THEN ':' || array_to_string(({_PATH})[:3], '/') ELSE '' END, {_named('title', 8)}, {_named('snippet', 10)})"
#: Events as observations with urls, titles and snippets; some have only a short snippet, some are too short to be merged.
_ROWS = """r AS (SELECT event_id AS id, epoch_us(ts) AS us, event_type AS app, value, props,
  CASE WHEN user_id % 3 = 0 THEN 'https://Site' || (user_id % 7) || '.example//Docs/' || event_type || '/p' || (user_id % 11) || '/x?y=1' WHEN user_id % 13 = 1 THEN 'plain.example' WHEN user_id % 13 = 2 THEN '' END AS url,
  CASE WHEN user_id % 3 = 1 THEN 'Quarterly report, client ' || user_id ELSE 'Tab' END AS title,
  CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1 THEN '' ELSE 'the shared notes no. ' || (user_id % 29) || ' of ' || event_type END AS snippet,
  CASE WHEN event_id % 5 = 0 THEN 'short' ELSE repeat(event_type || ' ', 6) || props END AS text FROM events)"""


def _rows(spark, d):
    e, u = table(spark, d, "events"), F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    url = F.when(u % 3 == 0, text("https://Site", u % 7, ".example//Docs/", F.col("event_type"), "/p", u % 11, "/x?y=1")).when(u % 13 == 1, "plain.example").when(u % 13 == 2, "")
    n = F.col("event_id") % 9
    return e.select(
        F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("app"), "value", "props", url.alias("url"),
        F.when(u % 3 == 1, text("Quarterly report, client ", u)).otherwise("Tab").alias("title"),
        F.when(n == 0, "n/a").when(n == 1, "").otherwise(text("the shared notes no. ", u % 29, " of ", F.col("event_type"))).alias("snippet"),
        F.when(F.col("event_id") % 5 == 0, "short").otherwise(text(F.repeat(text(F.col("event_type"), " "), F.lit(6)), F.col("props"))).alias("text"),
    )


def anchored(spark, d):
    """The observations with anchor and eligible, as the continuity index takes them."""
    anchor = M.anchor(F.col("app"), F.col("url"), F.col("title"), F.col("snippet"))
    return _rows(spark, d).withColumns({"anchor": anchor, "eligible": M.eligible(F.col("text"), F.col("snippet")), "tags": F.array("app")})


_HEADS = f"""WITH {_ROWS}, a AS (SELECT *, {_ANCHOR} AS anchor, strlen(trim(text)) >= 36 OR strlen(trim(snippet)) >= 18 AS eligible FROM r),
h AS (SELECT *, CASE WHEN anchor IS NULL THEN id ELSE coalesce(last_value(CASE WHEN NOT eligible THEN id END IGNORE NULLS) OVER w, first_value(id) OVER w) END AS head
  FROM a WINDOW w AS (PARTITION BY anchor ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("z06_continuity_index", _HEADS + " SELECT id, anchor, eligible, head FROM h")
def _(spark, d):
    return M.continued(anchored(spark, d)).select("id", "anchor", "eligible", "head")


@query("z06_continued_stories", _HEADS + """ SELECT head, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_max(title, (us, id)) FILTER (trim(title) <> '') AS title, arg_max(url, (us, id)) FILTER (trim(url) <> '') AS url,
  array_to_string(list_sort(list_distinct(list(app))), ',') AS tags, max(value) AS value FROM h GROUP BY head""")
def _(spark, d):
    out = M.merged_stories(M.continued(anchored(spark, d)), ["title", "url"], ["tags"], ["value"])
    return out.withColumn("tags", F.array_join("tags", ","))


#: Embeddings with the documents of the same number as stored records of three apps; every tenth has no vector.
_STORE = """m AS (SELECT vec_id AS id, epoch_us(TIMESTAMP '2024-01-01' + INTERVAL 10 MINUTE * vec_id) AS us, 'App ' || (vec_id % 3) AS app,
  CASE WHEN vec_id % 4 = 0 THEN 'https://site' || (vec_id % 5) || '.example/p/' || (vec_id % 7) END AS url, 'Sheet ' || lang || ' ' || source AS title,
  text AS snippet, text, lang || ' ' || source AS shadow, CASE WHEN vec_id % 10 <> 7 THEN embedding::DOUBLE[] END AS embedding
  FROM embeddings JOIN documents ON doc_id = vec_id)"""


def stored(spark, d):
    """The stored records of the merge target query."""
    x = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("doc_id") == F.col("vec_id"))
    v = F.col("vec_id")
    url = F.when(v % 4 == 0, F.concat(F.lit("https://site"), (v % 5).cast("string"), F.lit(".example/p/"), (v % 7).cast("string")))
    us = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + v * 600_000_000
    return x.select(v.alias("id"), us.alias("us"), F.concat(F.lit("App "), (v % 3).cast("string")).alias("app"), url.alias("url"), F.concat_ws(" ", F.lit("Sheet"), "lang", "source").alias("title"), F.col("text").alias("snippet"), "text", F.concat_ws(" ", "lang", "source").alias("shadow"), F.when(v % 10 != 7, F.col("embedding")).alias("embedding"))


_OVERLAP = "CASE WHEN len(list_distinct(list_concat(a.w_{0}, b.w_{0}))) = 0 THEN 0 ELSE len(list_intersect(a.w_{0}, b.w_{0})) / len(list_distinct(list_concat(a.w_{0}, b.w_{0}))) END"
_LIKENESS = " + ".join(f"{w} * {_OVERLAP.format(f)}" for f, w in M.WORD_SHARES.items())
_PAGE = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0}.url)), '^https?://', ''), '[?#].*$', ''), '/+$', '')"


@query("z07_merge_targets", f"""WITH {_STORE}, x AS (SELECT id, us, app, url, embedding, lower({_HOST}) AS host, {_ANCHOR} AS anchor, {', '.join(f"list_distinct({_words('left(text, 1000)' if f == 'text' else f)}) AS w_{f}" for f in M.WORD_SHARES)} FROM m),
p AS (SELECT a.id, b.id AS o, a.app, b.app AS o_app, a.us - b.us AS apart, a.embedding IS NULL AS bare, CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN greatest(0, least(1, list_cosine_similarity(a.embedding, b.embedding))) ELSE 0 END AS vector,
  b.embedding IS NOT NULL AS has, {_LIKENESS} AS words, coalesce(a.anchor = b.anchor, false) AS met, coalesce(a.host = b.host, false) AS site, coalesce({_PAGE.format('a')} = {_PAGE.format('b')}, false) AS page
  FROM x a JOIN x b ON b.us < a.us AND b.us > a.us - 604800000000),
s AS (SELECT *, 0.5 * vector + 0.42 * words + 0.08 * site::INT + 0.32 * met::INT AS score, 0.9 * words + 0.08 * site::INT + 0.14 * page::INT + 0.24 * met::INT AS by_words FROM p),
t AS (SELECT *, CASE WHEN met THEN score >= 0.58 AND words >= 0.18 ELSE (words >= 0.72 AND score >= 0.8) OR (score >= 0.86 AND vector >= 0.82 AND words >= 0.28) END AS passes,
  apart <= 2700000000 AND (page OR (site AND ((met AND words >= 0.52) OR (vector >= 0.93 AND words >= 0.7)))) AS across FROM s),
same AS (SELECT id, arg_max(o, (score, -o)) AS target, 'same_app' AS arm, max(score) AS score FROM (SELECT * FROM t WHERE NOT bare AND has AND app = o_app QUALIFY row_number() OVER (PARTITION BY id ORDER BY vector DESC, o) <= 24) WHERE passes GROUP BY id),
other AS (SELECT id, arg_max(o, (score, -o)) AS target, 'other_app' AS arm, max(score) AS score FROM (SELECT * FROM t WHERE NOT bare AND has AND apart < 86400000000 AND id NOT IN (SELECT id FROM same) QUALIFY row_number() OVER (PARTITION BY id ORDER BY vector DESC, o) <= 32) WHERE app <> o_app AND passes AND across GROUP BY id),
words AS (SELECT id, arg_max(o, (by_words, -o)) AS target, 'words' AS arm, max(by_words) AS score FROM (SELECT * FROM t WHERE bare AND app = o_app AND apart < 86400000000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY words DESC, o) <= 36) WHERE CASE WHEN met THEN words >= 0.24 AND by_words >= 0.46 ELSE words >= 0.66 AND by_words >= 0.74 END GROUP BY id)
SELECT id, target, arm, round(score, 6) AS score FROM (FROM same UNION ALL FROM other UNION ALL FROM words)""")
def _(spark, d):
    rows = stored(spark, d)
    return M.best_targets(rows, rows).withColumn("score", F.round("score", 6))


@query("z09_merged_history")
def _(spark, d):
    """Ordered fold over days with carries and commits; tests compare it with one fold over all rows, and a stopped run with a whole one."""
    return H.merge_history(stored(spark, d), new_folder(spark, "history"), M.DAY)
