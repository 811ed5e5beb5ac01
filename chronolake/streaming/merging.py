"""Merging of observations into stories: continuity anchors, merge targets, and a stream that keeps both.

A story is named by its first row, the head. ``continued`` finds the heads of a
history, ``continued_stream`` those of a stream with one id of state for each
anchor; ``story_sink`` and ``stories`` keep the merged records as partial
aggregates by micro-batch, so that a replayed batch writes the same files again.
``best_targets`` finds for rows without a head the stored record they join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as X
from ..functions import url as L
from ..functions import vector as V
from ..operators import retrieval as R
from ..operators.checkpoints import cut, new_folder
from ..session import ship

DAY = 86_400_000_000
# Words that name no page.
GENERIC = "the and for with this that from your you are was were have has into about after before then just there here user app window tab page open opened search searched www http https com".split()
# Shares of the words of snippet, title, text (its first 1,000 characters) and shadow in the likeness of two records.
WORD_SHARES = {"snippet": 0.42, "title": 0.26, "text": 0.20, "shadow": 0.12}
TEXT_CHARS = 1000
# What the likeness by words alone adds.
BY_WORDS = {"words": 0.9, "domain": 0.08, "page": 0.14, "anchor": 0.24}
# Candidates and days of the three searches for a target.
SAME_APP, OTHER_APP, WORDS_ONLY = (24, 7), (32, 1), (36, 1)
BLOCK = (1024, 4096)  # incoming and stored rows that meet in one task


def key_words(c: Column) -> Column:
    """Words of over two bytes that are not generic, in order."""
    return F.filter(X.words(F.coalesce(c, F.lit(""))), lambda w: (F.octet_length(w) > 2) & ~w.isin(GENERIC))


def host(url: Column) -> Column:
    """What stands before the first slash after the scheme; null if nothing does."""
    rest = F.coalesce(F.get(F.split(url, "://"), F.lit(1)), url)
    got = F.trim(F.element_at(F.split(rest, "/"), 1))
    return F.when(got != "", got)


def anchor(app: Column, url: Column, title: Column, snippet: Column) -> Column:
    """What rows of one page, one window title or one snippet share; null if a row has none of them."""
    rest = F.coalesce(F.get(F.split(url, "://"), F.lit(1)), url)
    parts = F.split(rest, "/")
    path = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    site = F.concat(F.lit("url:"), F.lower(host(url)), F.when(F.size(path) > 0, F.concat(F.lit(":"), F.array_join(F.slice(path, 1, 3), "/"))).otherwise(F.lit("")))
    key = F.regexp_replace(F.regexp_replace(F.lower(app), "[^\\p{L}\\p{N}]+", "_"), "^_|_$", "")
    key = F.concat(F.lit("app:"), F.when(key == "", F.lit("unknown")).otherwise(key))
    named = lambda c: F.array_join(F.slice(key_words(c), 1, 8), "_")
    by = lambda kind, c, least: F.when(F.octet_length(named(c)) >= least, F.concat(key, F.lit(f":{kind}:"), named(c)))
    return F.coalesce(site, by("title", title, 8), by("snippet", snippet, 10))


def eligible(text: Column, snippet: Column) -> Column:
    """Whether a row is long enough to be merged into another."""
    return (F.octet_length(F.trim(F.coalesce(text, F.lit("")))) >= 36) | (F.octet_length(F.trim(F.coalesce(snippet, F.lit("")))) >= 18)


def continued(df: DataFrame) -> DataFrame:
    """df with head, the id of the record each row belongs to. df: id, us, anchor, eligible.

    A row that is not eligible heads its anchor from then on; an eligible row joins
    the anchor's head, or becomes it where there is none. A row without anchor is
    its own head. Rows look back inside (anchor, day); between days one row for
    each day of an anchor is carried, so a very common anchor is no single task.
    """
    own = df.withColumn("_day", F.floor(F.col("us") / DAY))
    start = F.when(~F.col("eligible"), F.col("id"))
    inside = Window.partitionBy("anchor", "_day").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    days = own.where("anchor is not null").groupBy("anchor", "_day").agg(F.max_by("id", F.when(~F.col("eligible"), F.struct("us", "id"))).alias("_tail"), F.count_if(~F.col("eligible")).alias("_n"), F.min_by("id", F.struct("us", "id")).alias("_first"))
    over = Window.partitionBy("anchor").orderBy("_day")
    before = F.last(F.when(F.col("_n") > 0, F.col("_tail")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("anchor", "_day", before.alias("_before"), F.first("_first").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
    out = own.where("anchor is not null").withColumn("_in", F.last(start, ignorenulls=True).over(inside)).join(days, ["anchor", "_day"])
    out = out.withColumn("head", F.coalesce("_in", "_before", "_first")).select(*df.columns, "head")
    return out.unionByName(df.where("anchor is null").withColumn("head", F.col("id")))


def continued_stream(df: DataFrame) -> DataFrame:
    """The streaming form of ``continued``: rows in order of us and id inside a micro-batch, one id of state for each anchor."""
    ship(df.sparkSession)

    def f(key, pdfs, state):
        head = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["us", "id"], kind="stable")
        heads = []
        for i, merges in zip(rows["id"], rows["eligible"]):
            head = int(i) if head is None or not merges else head
            heads.append(head)
        state.update((head,))
        yield rows.assign(head=heads)

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", head long"
    kept = df.where("anchor is not null").groupBy("anchor").applyInPandasWithState(f, kinds, "head long", "append", GroupStateTimeout.NoTimeout)
    return kept.unionByName(df.where("anchor is null").withColumn("head", F.col("id").cast("long")))


def _partial(df: DataFrame, texts: list[str], lists: list[str], scores: list[str]) -> DataFrame:
    """Partial records by head: counts, times, the newest filled texts with their place, unions and best scores."""
    newest = lambda c: F.max(F.when(F.trim(F.col(c)) != "", F.struct("us", "id", F.col(c).alias("v")))).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return df.groupBy("head").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), *map(newest, texts), *map(union, lists), *[F.max(c).alias(c) for c in scores])


def _whole(parts: DataFrame, texts: list[str], lists: list[str], scores: list[str]) -> DataFrame:
    """Records out of partial ones, in any order and cut."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return parts.groupBy("head").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), *[F.max(c)["v"].alias(c) for c in texts], *map(union, lists), *[F.max(c).alias(c) for c in scores])


def merged_stories(df: DataFrame, texts: list[str] = (), lists: list[str] = (), scores: list[str] = ()) -> DataFrame:
    """One record for each head: newest filled texts, union of lists, best scores, first and last time, count."""
    return _whole(_partial(df, texts, lists, scores), texts, lists, scores)


def story_sink(path: str, texts: list[str] = (), lists: list[str] = (), scores: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: batch k's partial records replace the folder batch=k, so a replay changes nothing."""

    def write(batch: DataFrame, no: int) -> None:
        _partial(batch, texts, lists, scores).write.mode("overwrite").parquet(f"{path}/batch={no}")

    return write


def stories(spark, path: str, texts: list[str] = (), lists: list[str] = (), scores: list[str] = ()) -> DataFrame:
    """The records as they stand, out of all micro-batches that were written."""
    return _whole(spark.read.parquet(path), texts, lists, scores)


def _vectors(q, x) -> np.ndarray:
    """The cosines of two lists of vectors within 0 and 1, summed in the order of ``vector.cosine``, over the shorter length."""
    out = np.zeros((len(q), len(x)))
    sizes = lambda v: np.array([len(e) for e in v])
    qs, xs = sizes(q), sizes(x)

    def total(a, b, pair):
        s = np.zeros((len(a), len(b)) if pair else len(a))
        for i in range(a.shape[1]):
            s += np.multiply.outer(a[:, i], b[:, i]) if pair else a[:, i] * a[:, i]
        return s

    with np.errstate(all="ignore"):
        for m in np.unique(qs):
            for n in np.unique(xs):
                i, j, d = np.flatnonzero(qs == m), np.flatnonzero(xs == n), min(m, n)
                a, b = (np.stack([v[r][:d] for r in rows]).astype(float) for v, rows in ((q, i), (x, j)))
                both = np.multiply.outer(np.sqrt(total(a, a, False)), np.sqrt(total(b, b, False)))
                s = np.where(both == 0, 0.0, total(a, b, True) / both)
                out[np.ix_(i, j)] = np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0))
    return out


def _coded(now: pa.Table, old: pa.Table) -> list:
    """For each field of WORD_SHARES its share, the number of different words, and both tables' words as (starts, numbers)."""
    out = []
    for f, share in WORD_SHARES.items():
        a, b = (t.column(f"w_{f}").combine_chunks() for t in (now, old))
        words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        starts = [np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))].astype(int) for v in (a, b)]
        out.append((share, len(words.dictionary), starts[0], codes[: starts[0][-1]], starts[1], codes[starts[0][-1] :]))
    return out


def _likeness(coded: list, marks: list, i: int, js: np.ndarray) -> np.ndarray:
    """Weighted overlap of the words of row i and of the stored rows js; 0 for a field that both lack."""
    out = np.zeros(len(js))
    for (share, _, at, own, starts, codes), mark in zip(coded, marks):
        mine, sizes = own[at[i] : at[i + 1]], starts[js + 1] - starts[js]
        mark[mine] = True
        hits = np.r_[0, np.cumsum(mark[np.concatenate([codes[starts[j] : starts[j + 1]] for j in js])])] if len(js) else np.zeros(1, int)
        mark[mine] = False
        ends = np.cumsum(sizes)
        both = hits[ends] - hits[ends - sizes]
        union = len(mine) + sizes - both
        out += share * np.where(union == 0, 0.0, both / np.maximum(union, 1))
    return out


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest values, of equals the first."""
    if len(values) <= k:
        return np.arange(len(values))
    least = np.partition(values, len(values) - k)[len(values) - k]
    over = np.flatnonzero(values > least)
    return np.r_[over, np.flatnonzero(values == least)[: k - len(over)]]


def _block(span: int, k: int, by: str):
    """Of one block of incoming and one of stored rows: each incoming row's k best earlier ones within ``span``, with vector and words."""

    def f(now: pa.Table, old: pa.Table) -> pa.Table:
        found = []
        if now.num_rows and old.num_rows:
            old = old.sort_by("id")
            numbers = lambda t, c: t.column(c).to_numpy()
            us, own, o_us, ids = numbers(now, "us"), numbers(now, "id"), numbers(old, "us"), numbers(old, "id")
            near = _vectors(numbers(now, "embedding"), numbers(old, "embedding")) if by == "vector" else None
            coded = _coded(now, old)
            marks = [np.zeros(n, bool) for _, n, *_ in coded]
            for i in range(len(own)):
                js = np.flatnonzero(((o_us < us[i]) | ((o_us == us[i]) & (ids < own[i]))) & (o_us > us[i] - span))
                if by == "vector":
                    js = js[_best(near[i, js], k)]
                words, vector = _likeness(coded, marks, i, js), near[i, js] if by == "vector" else np.zeros(len(js))
                if by == "words":
                    top = _best(words, k)
                    js, words, vector = js[top], words[top], vector[top]
                found.append((np.full(len(js), own[i]), ids[js], vector, words))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.float64()])], ["id", "o_id", "vector", "words"])

    return f


def _near(incoming: DataFrame, store: DataFrame, days: int, keys: list[str], k: int, by: str) -> DataFrame:
    """(id, o_id, vector, words): for each incoming row the k best (by vector or words) of the stored rows of up to ``days`` before it.

    Times are cut into spans; a span's rows meet those of it and of the span before as
    one block of each key, in more blocks where a span holds more than ``BLOCK`` rows,
    so a text goes to as many tasks as its row, not to every pair. Both: id, us, keys
    and the words; embedding if by vector.
    """
    span = days * DAY
    full = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in ("id", "us", *keys))).withColumn("id", F.col("id").cast("long")).withColumn("_t", F.floor(F.col("us") / span))
    cols = ["id", "us", *[f"w_{f}" for f in WORD_SHARES], *(["embedding"] if by == "vector" else [])]
    now = full(incoming).select(*keys, "_t", *cols)
    old = full(store).select(*keys, F.explode(F.array(F.col("_t"), F.col("_t") + 1)).alias("_t"), *cols)
    parts = lambda df, most, name: df.groupBy(*keys, "_t").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    of = parts(now, BLOCK[0], "_m").join(parts(old, BLOCK[1], "_n"), [*keys, "_t"])
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = [*keys, "_t", "_b", "_c"]
    left = now.join(of, [*keys, "_t"]).withColumn("_b", deal("_m")).withColumn("_c", every("_n")).select(*group, *cols)
    right = old.join(of, [*keys, "_t"]).withColumn("_b", every("_m")).withColumn("_c", deal("_n")).select(*group, *cols)
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_block(span, k, by), "id long, o_id long, vector double, words double")
    return _top(found, by, k)


def _top(pairs: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each incoming row; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy("id").orderBy(F.desc(by), "o_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def best_targets(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """id, target, arm and score of every incoming row that joins a stored record before it. Both: id, us, app, url, title, snippet, text, shadow, embedding.

    Three searches: the 24 nearest vectors of its app in 7 days; where none of those
    passes, the 32 nearest of any app in a day, of which those of another app may
    pass; for rows without a vector the 36 of its app in a day that share most words.
    Of what passes, the best score wins, then the smaller id. Words are made once
    for each row and compared inside the blocks in which rows meet.
    """
    spark = incoming.sparkSession
    ship(spark)
    has = ~V.low_signal(F.col("embedding"))

    def words(df: DataFrame) -> str:
        at = new_folder(spark, "targets")
        df = df.repartition("id")  # few row groups may hold all the texts
        own = [F.array_distinct(key_words(F.substring(F.col(f), 1, TEXT_CHARS) if f == "text" else F.col(f))).alias(f"w_{f}") for f in WORD_SHARES]
        df.select("id", "us", "app", "url", anchor(F.col("app"), F.col("url"), F.col("title"), F.col("snippet")).alias("anchor"), F.when(has, F.col("embedding")).alias("embedding"), *own).write.parquet(at)
        return at

    at = words(incoming)
    now, old = spark.read.parquet(at), spark.read.parquet(at if store is incoming else words(store))

    def scored(pairs: DataFrame) -> DataFrame:
        """Candidate pairs (id, o_id, vector, words) with anchor, domain and page."""
        left = now.select("id", "us", "app", "url", "anchor")
        right = old.select(F.col("id").alias("o_id"), F.col("us").alias("o_us"), F.col("app").alias("o_app"), F.col("url").alias("o_url"), F.col("anchor").alias("o_anchor"))
        both = pairs.join(left, "id").join(right, "o_id")
        return both.select("id", "o_id", "us", "o_us", "app", "o_app", "url", "o_url", "vector", "words", F.coalesce(F.col("anchor") == F.col("o_anchor"), F.lit(False)).alias("met"), F.coalesce(host(F.col("url")) == host(F.col("o_url")), F.lit(False)).alias("site"))

    def chosen(rows: DataFrame, arm: str) -> DataFrame:
        best = F.max(F.struct("score", (-F.col("o_id")).alias("m")))
        return rows.groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.m")).alias("target"), F.lit(arm).alias("arm"), F.col("b.score").alias("score"))

    ready, bare, known = now.where("embedding is not null"), now.where("embedding is null"), old.where("embedding is not null")
    rated = lambda rows: rows.withColumn("score", R.merge_score(F.col("words"), F.col("vector"), F.col("site"), F.col("met")))
    passes = R.merge_allowed(F.col("score"), F.col("words"), F.col("vector"), F.col("met"))
    same = cut(chosen(rated(scored(_near(ready, known, SAME_APP[1], ["app"], SAME_APP[0], "vector"))).where(passes), "same_app"))
    rest = ready.join(same.select("id"), "id", "left_anti")
    across = R.cross_app_merge(F.col("us") - F.col("o_us"), F.col("url"), F.col("o_url"), F.col("words"), F.col("vector"), F.col("met"))
    other = rated(scored(_near(rest, known, OTHER_APP[1], [], OTHER_APP[0], "vector"))).where((F.col("app") != F.col("o_app")) & passes & across)
    likely = scored(_near(bare, old, WORDS_ONLY[1], ["app"], WORDS_ONLY[0], "words"))
    page = F.coalesce(L.page_key(F.col("url")) == L.page_key(F.col("o_url")), F.lit(False))
    score = sum((F.lit(BY_WORDS[k]) * c.cast("double") for k, c in (("words", F.col("words")), ("domain", F.col("site")), ("page", page), ("anchor", F.col("met")))), F.lit(0.0))
    likely = likely.withColumn("score", score).where(R.merge_allowed_by_words(F.col("score"), F.col("words"), F.col("met")))
    return same.unionByName(chosen(other, "other_app")).unionByName(chosen(likely, "words"))
