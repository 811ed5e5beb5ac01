"""Continuity index, merge targets and resumable history: streams, replays and restarts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolake.plans import merge_queries as Q
from chronolake.streaming import history as H
from chronolake.streaming import ingest
from chronolake.streaming import merging as M


def heads(rows):
    """Row by row: id, us, anchor, eligible -> head."""
    index, out = {}, {}
    for i, us, anchor, merges in sorted(rows, key=lambda r: (r[1], r[0])):
        head = i
        if anchor is not None:
            head = index.get(anchor, i) if merges else i
            index[anchor] = head
        out[i] = head
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    return [(i, r.randrange(6) * M.DAY + r.randrange(50), r.choice([None, "a", "b", "hot", "hot", "hot"]), r.random() < 0.8) for i in range(400)]


SCHEMA = "id long, us long, anchor string, eligible boolean"


def test_heads_of_a_history(spark, rows):
    got = M.continued(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id: r["head"] for r in got} == heads(rows)


def test_stream_and_replay_give_the_history(spark, rows, tmp_path):
    """Micro-batches give the batch form's records; writing a micro-batch again changes nothing."""
    rows = [(*r, f"t{r[0] % 9}" if r[0] % 4 else " ", [f"x{r[0] % 5}"], float(r[0] % 17)) for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    schema = SCHEMA + ", title string, tags array<string>, score double"
    source, path = str(tmp_path / "source"), str(tmp_path / "stories")
    fields = (["title"], ["tags"], ["score"])
    sink, seen = M.story_sink(path, *fields), []

    def write(batch, no):
        sink(batch, no)
        sink(batch, no)  # the same micro-batch again
        seen.append(no)

    for k in range(3):
        spark.createDataFrame(rows[k * 140 : (k + 1) * 140], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.flush(M.continued_stream(spark.readStream.schema(schema).parquet(source)), write, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert len(set(seen)) == 3
    expected = M.merged_stories(M.continued(spark.createDataFrame(rows, schema)), *fields)
    order = lambda df: sorted(map(tuple, df.select("head", "first_us", "last_us", "n", "title", "tags", "score").collect()))
    assert order(M.stories(spark, path, *fields)) == order(expected)


def folded(rows):
    """One fold for each app over all its rows."""
    apps, out = defaultdict(list), {}
    for r in rows:
        apps[r["app"]].append(r)
    for own in apps.values():
        records = []
        for row, target, how in H.fold(sorted(own, key=lambda r: (r["us"], r["id"])), records, {}):
            out[row["id"]] = (row["id"] if target is None else target, how)
            del records[: -H.NEWEST - 1]
    return out


def test_history_goes_on_where_it_stopped(spark, sf, tmp_path, monkeypatch):
    df = Q.stored(spark, sf)
    rows = [r.asDict() for r in H.prepared(df, M.DAY).collect()]
    whole = folded(rows)
    path, done = f"file://{tmp_path}/history", []
    real = H._fold_part
    monkeypatch.setattr(H, "_fold_part", lambda s, r, p, b, part: (done.append(part), real(s, r, p, b, part)))
    H.merge_history(df, path, M.DAY, stop_after=1)
    assert len(done) == 1
    got = {r.id: (r.target, r.by) for r in H.merge_history(df, path, M.DAY).collect()}
    assert got == whole and len(done) == len(set(done)) == len({r["part"] for r in rows})
    assert any(how == "anchor" for _, how in got.values())
    again = H.merge_history(df, path, M.DAY)
    assert again.count() == len(rows) and len(done) == len(set(done))
    last = max(done)
    changed = df.withColumn("snippet", F.when(F.floor(F.col("us") / M.DAY) == last, "something else altogether").otherwise(F.col("snippet")))
    H.merge_history(changed, path, M.DAY)
    assert done[-1] == last and done.count(last) == 2 and len(done) == len(set(done)) + 1


def test_no_targets_in_empty_tables(spark):
    none = spark.createDataFrame([], "id long, us long, app string, url string, title string, snippet string, text string, shadow string, embedding array<double>")
    assert M.best_targets(none, none).count() == 0
    assert M.continued(spark.createDataFrame([], SCHEMA)).count() == 0


def test_history_folds_many_parts_in_one_job(spark, sf, tmp_path, monkeypatch):
    hour = M.DAY // 24
    df = Q.stored(spark, sf)
    rows = [r.asDict() for r in H.prepared(df, hour).collect()]
    assert len({r["part"] for r in rows}) > 6
    real, calls = H._fold_part, []
    monkeypatch.setattr(H, "_fold_part", lambda *a: (calls.append(a[-1]), real(*a)))
    path = f"file://{tmp_path}/hours"
    H.merge_history(df, path, hour, stop_after=3)
    monkeypatch.setattr(H, "BATCH_ROWS", 60, raising=False)
    got = {r.id: (r.target, r.by) for r in H.merge_history(df, path, hour).collect()}
    assert got == folded(rows) and len(calls) < len({r["part"] for r in rows}) // 2
    before = len(calls)
    H.merge_history(df, path, hour)
    assert len(calls) == before


@pytest.mark.parametrize("by", ["vector", "words"])
def test_targets_meet_in_blocks_as_in_pairs(spark, monkeypatch, by):
    """Words and vectors go to blocks of rows, not to pairs; vectors of several lengths, negative and equal ones, rows without words, keys without value."""
    r = random.Random(3)
    words = lambda n: r.sample("one two three four five six".split(), r.randrange(n))
    vector = lambda: r.choice([[1.0, 0.0], [0.0, 0.0], [-1.0, 0.5, 2.0], [r.uniform(-1, 1) for _ in range(3)]])
    rows = [(i, r.randrange(30) * M.DAY // 10, r.choice(["a", "a", "b", None]), vector(), words(6), words(3), words(2), []) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, us long, app string, embedding array<double>, w_snippet array<string>, w_title array<string>, w_text array<string>, w_shadow array<string>")
    cosine, share = M.V.cosine, lambda f, w: F.lit(w) * M.X.jaccard(F.col(f"a.w_{f}"), F.col(f"b.w_{f}"))
    pairs = df.alias("a").join(df.alias("b"), F.expr(f"a.app = b.app AND (b.us < a.us OR b.us = a.us AND b.id < a.id) AND b.us > a.us - {M.DAY}"))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("a.embedding"), F.col("b.embedding")))) if by == "vector" else F.lit(0.0)
    pairs = pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("o_id"), near.alias("vector"), sum((share(f, w) for f, w in M.WORD_SHARES.items()), F.lit(0.0)).alias("words"))
    want = sorted(map(tuple, M._top(pairs, by, 4).collect()))
    for block in ((1024, 4096), (3, 5)):
        monkeypatch.setattr(M, "BLOCK", block)
        assert sorted(map(tuple, M._near(df, spark.createDataFrame(df.rdd, df.schema), 1, ["app"], 4, by).collect())) == want and want


def test_history_writes_a_record_where_it_changes(spark, sf, tmp_path):
    path = f"file://{tmp_path}/history"
    df = Q.stored(spark, sf).where("id < 300")
    H.merge_history(df, path, M.DAY // 8, stop_after=5)
    got = {r.id: (r.target, r.by) for r in H.merge_history(df, path, M.DAY // 8).collect()}
    assert got == folded([r.asDict() for r in H.prepared(df, M.DAY // 8).collect()])
    told = spark.read.parquet(f"{path}/parts")
    assert told.where("kind = 'record'").count() <= 300 and told.where("kind = 'record'").groupBy("id", "part").count().where("count > 1").isEmpty()  # every part wrote all newest records
    assert told.where("kind = 'place' and record.w_text is not null").isEmpty() and told.where("kind = 'place'").count() > 300
    assert not list((tmp_path / "history").glob("rows-*"))  # each run left its rows
