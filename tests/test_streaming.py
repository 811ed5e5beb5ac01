import pytest
from pyspark.sql import functions as F

from chronolake.streaming import batch as B
from chronolake.streaming import ingest as I

S = 1_000_000


def feed(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drain(df, tmp_path, spark):
    out = str(tmp_path / "out")
    q = I.flush(df, lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("refresh, kept", [(True, [0, 400]), (False, [0, 100, 400])])
def test_dedup(spark, tmp_path, refresh, kept):
    src = feed(spark, tmp_path / "in", [[("k", t * S) for t in (0, 50, 100)], [("k", 150 * S), ("k", 400 * S)]], "key string, us long")
    got = drain(I.dedup(src, "key", "us", 90, refresh), tmp_path, spark)
    assert sorted(r.us // S for r in got.collect()) == kept


def test_batch_forms_agree(spark):
    rows = [(i, "k", t * S, 0) for i, t in enumerate((0, 50, 100, 150, 400))]
    df = spark.createDataFrame(rows, "id long, key string, us long, day int")
    assert sorted(r.us // S for r in B.sliding_dedup(df, ["key"], 90).collect()) == [0, 400]
    assert sorted(r.us // S for r in B.tumbling_dedup(df, ["key"], 90).collect()) == [0, 100, 400]


def test_novelty_and_switches(spark, tmp_path):
    src = feed(spark, tmp_path / "in", [[("s", 1, [1.0, 0.0]), ("s", 2, [1.0, 0.01]), ("s", 3, [0.0, 1.0])]], "key string, us long, v array<double>")
    assert sorted(r.us for r in drain(I.admit_novel(src, "key", "v", "us"), tmp_path, spark).collect()) == [1, 3]


def test_switch_ring(spark, tmp_path):
    src = feed(spark, tmp_path / "in", [[("s", i, f"a{i % 7}") for i in range(20)]], "key string, us long, app string")
    assert drain(I.switch_ring(src, "key", "app", "us"), tmp_path, spark).count() == 2


def test_policy_is_applied_at_the_flush(spark, tmp_path):
    src = feed(spark, tmp_path / "in", [[("ok", 1), ("blocked", 2)]], "app string, us long")
    out = str(tmp_path / "out")
    I.flush(src, lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "ck"), policy=F.col("app") != "blocked", once=True).awaitTermination()
    assert [r.app for r in spark.read.parquet(out).collect()] == ["ok"]


def test_share_chain(spark):
    df = spark.createDataFrame([("BLOCKED", "t"), ("LOCAL_ONLY", "t"), ("SHARED_ANON", "t")], "d string, text string")
    got = I.share_chain(df, F.col("d"), F.lit(True), "text", F.upper("text")).orderBy("d").collect()
    assert [(r.outcome, r.text) for r in got] == [("blocked", None), ("local", None), ("queued", "T")]
