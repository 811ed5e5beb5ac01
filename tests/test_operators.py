import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.functions import vector as V
from chronolake.operators import context as C
from chronolake.operators import graph as G
from chronolake.operators import joins as J
from chronolake.operators import retrieval as R
from chronolake.operators import windows as W
from chronolake.sources import tables as S


def test_previous_row_crosses_buckets(spark):
    df = spark.createDataFrame([(1, 10, 0, "a"), (2, 20, 0, "b"), (3, 30, 2, "b"), (4, 40, 3, "c")], "id long, us long, day int, app string")
    got = {r.id: r.prev_app for r in W.previous_row(df, ["us", "id"], ["app"], "day").collect()}
    assert got == {1: None, 2: "a", 3: "b", 4: "b"}


def test_sessions_break_on_keys_and_gaps(spark):
    m = 60_000_000
    df = spark.createDataFrame([(1, 0, 0, "a"), (2, 5 * m, 0, "a"), (3, 6 * m, 0, "b"), (4, 40 * m, 1, "b")], "id long, us long, day int, app string")
    assert [r.session_no for r in W.sessions(df, ["app"]).orderBy("id").collect()] == [1, 1, 2, 3]


def test_interval_join_bounds(spark):
    p = spark.createDataFrame([(1, 0), (2, 10), (3, 11)], "id long, t long")
    i = spark.createDataFrame([("a", 0, 10), ("b", 11, 5)], "name string, lo long, hi long")
    assert sorted((r.id, r.name) for r in J.interval_join(p, "t", i, "lo", "hi", 4).collect()) == [(1, "a"), (2, "a")]


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id long, key string, us long")
    right = spark.createDataFrame([("k", 5, 50), ("k", 3, 30)], "key string, us long, v long")
    assert {r.id: r.asof_v for r in J.as_of(left, right, "key", "us", ["v"]).collect()} == {1: 50, 2: None, 3: None}


def test_parent_chain_stops_at_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long")
    got = J.parent_chain(df, spark.createDataFrame([(1,)], "id long"), 9).collect()
    assert sorted((r.ancestor, r.hops) for r in got) == [(1, 0), (2, 1), (3, 2)]


@pytest.fixture
def path_graph(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (1, 4, 0.4), (4, 3, 0.4), (5, 6, 0.9), (3, 99, 0.9), (6, 7, 0.1)], "source long, target long, confidence double").withColumn("edge_type", F.lit("uses"))
    return n, e


def test_graph(spark, path_graph):
    n, e = path_graph
    adj = G.adjacency(n, e)
    assert adj.count() == 10  # dangling and weak edges are out
    got = {r.id: (r.hops, r.path_confidence) for r in G.bfs(adj, n.where("id = 1"), 2).collect()}
    assert got == {1: (0, 1.0), 2: (1, 0.9), 4: (1, 0.4), 3: (2, 0.5)}
    labels = G.components(n, adj)
    assert {r.id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    best = G.shortest_path(adj, 1, 3).first()
    assert (best.hops, best.path, best.mean_confidence) == (2, [1, 2, 3], 0.7)
    assert G.bridges(n, adj, labels).count() == 0
    ranks = {r.id: r.r for r in G.pagerank(n, adj).collect()}
    assert ranks[7] == pytest.approx(0.15 / 7) and len(ranks) == 7


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, at long")
    assert sorted((r.id, r.v) for r in S.upsert(old.withColumn("at", F.lit(0).cast("long")), new, ["id"], ["at"]).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted((r.id, r.v) for r in S.insert_absent(old, new.drop("at"), ["id"]).collect()) == [(1, "a"), (2, "b"), (3, "z")]


def test_deletes_keep_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, age long")
    kept, n = S.delete(df, F.col("age") > 3)
    assert [r.id for r in kept.collect()] == [2] and n.first()[0] == 1


def test_staged_table(spark, tmp_path):
    t = S.Staged(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.replace(spark.range(3))
    t.append(spark.range(3, 5))
    t.replace(t.read().where("id > 1"))
    assert sorted(r.id for r in t.read().collect()) == [2, 3, 4]


def test_logs(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    S.append_log(spark.createDataFrame([(1, "a")], "ts long, mode string"), at)
    S.append_log(spark.createDataFrame([(2, "b")], "ts long, mode string"), at)
    assert [r.mode for r in S.read_log(spark, at, "ts long, mode string").collect()] == ["b", "a"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"ts": 1}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        S.read_log(spark, f"file://{tmp_path}/bad", "ts long, mode string").collect()


def test_vector_dimension_is_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="2 numbers expected"):
        S.check_dimension(df, "v", 2).collect()
    assert R.knn(df, "v", [1.0, 2.0], 5).count() == 1
    assert R.similar_to(df, "v", 9, 5).count() == 0


def test_gate_and_diversity(spark):
    p = R.Profile("alpha beta")
    rows = [(1, "alpha beta one", 0.9, "x", 0), (2, "alpha beta one", 0.8, "x", 0), (3, "alpha other words here", 0.5, "y", 9), (4, "nothing alike", 0.6, "y", 9), (5, "alpha weak", 0.1, "z", 9)]
    pool = R.with_text(spark.createDataFrame(rows, "id long, text string, score double, app string, us long"), F.col("text"))
    kept = R.relevance_gate(pool, p)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    assert [r.id for r in R.diversify(kept, 5).orderBy("place").collect()] == [1, 3]


def test_intents_of_a_column_are_those_of_single_questions(spark):
    from chronolake.plans.search_queries import _ASKED

    asked = [*_ASKED, "Why is it broken?", "DEFINE x", "what are", "how do I", "", "seen before: continue"]
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", R.planner_intents(F.col("q")).alias("i")).collect()
    assert {r.q: r.i for r in got} == {q: R.planner_intent(R.Profile(q)) for q in asked}
    assert all(R.plan(q)["intent"] == i for q, i in _ASKED.items())


def test_gates_of_a_pool(spark):
    rows = [(1, "gamma", 0.2, 0), (2, "rust 7 beta", 0.9, 5), (3, "beta only", 0.29, 5), (4, "rust", 0.28, 5), (5, "beta rust 7", 0.5, 5)]
    pool = R.with_text(spark.createDataFrame(rows, "id long, text string, score double, us long"), F.col("text")).withColumn("signal", F.lit(0.0))
    ids = lambda q, **k: sorted(r.id for r in R.relevance_gate(pool, R.Profile(q), **k).collect())
    assert ids("rust beta") == [2, 3, 5]  # 4 is under .32 of the best
    assert ids("rust beta 7") == [2, 3, 5] and ids("delta 7") == [2, 5]
    assert ids("latest rust", now_us=F.lit(15 * 86_400_000_000)) == [] and ids("latest rust", now_us=F.lit(13 * 86_400_000_000)) == [2, 5]
    assert ids("what is watch") == [] and ids("") == [2, 3, 5]


def test_near_copies_and_third_rows_of_a_session_go():
    words = [f"w{i}" for i in range(30)]
    row = lambda i, toks, session: {"id": i, "toks": toks, "session": session}
    rows = [row(1, words, "a"), row(2, words[:28] + ["x", "w28"], "b"), row(3, words[:20], "a"), row(4, words[10:], "a"), row(5, [], "c"), row(6, ["other"], "c")]
    assert [r["id"] for r in R.fuzzy_dedup(rows, 10)] == [1, 3, 6]
    assert len(R.fuzzy_dedup([row(i, [f"u{i}"], str(i)) for i in range(50)], 3)) == 6 and len(R.fuzzy_dedup([row(i, [f"u{i}"], str(i)) for i in range(50)], 99)) == 30


def test_selection_for_diversity():
    row = lambda i, score, app, place, slot, signal=0.0: {"id": i, "score": score, "app": app, "place": place, "us": slot * R.SLOT_US, "signal": signal}
    top = [row(i, 0.95, "x", "p", 0) for i in (1, 2, 3)]
    rest = [row(4, 0.90, "x", "p", 0), row(5, 0.70, "y", "q", 1), row(6, 0.66, "z", "p", 2, 1.0), row(7, 0.59, "n", "n", 3)]
    # 5 gains .21, 6 gains .10 - .24 + .04 + .04, 4 loses .30 + .24 + .09, 7 is under the floor
    assert [r["id"] for r in R.diverse(top + rest, 6)] == [1, 2, 3, 5, 6, 4]
    assert [r["id"] for r in R.diverse(top + rest, 9)] == [1, 2, 3, 5, 6, 4]
    assert R.diverse([], 5) == [] and [r["id"] for r in R.diverse(top + rest, 2)] == [1, 2]


def test_chunks():
    from chronolake.operators import chunking as C

    assert C.chunks("", "") == [] and C.chunks("", "--\n::\n") == [("plain", "-- ::")]
    got = C.chunks("Notes - App", "\n".join(["one plain line of words"] * 3 + [f"plain line number {i} with some more words in it" for i in range(40)] + ["$ cargo build"]))
    assert len(got) >= 3 and got[0][1].startswith("Notes - App\none plain line") and sum("one plain line of words" in t for _, t in got) == 1
    assert all(len(t) <= 1100 for _, t in got) and got[-1][0] == "code"
    long = C.chunks("", " ".join(f"word{i}" for i in range(2000)))
    assert all(len(t) <= 1800 for _, t in long) and len(long) > 5
    assert [C.kind_of(x) for x in ("https://e.org", "a - b", "From: x", "search: y", "let x", "words only")] == ["url", "title", "email", "search", "code", "plain"]


def test_tasks(spark):
    from chronolake.operators import chunking as C

    df = spark.createDataFrame([(1, "- Reply to Ann about it\n2) pay the rent today\ntodo\n* Reply to Ann, about it\n|write the report|")], "id long, text string")
    assert sorted((r.title, r.type) for r in C.task_lines(df, "id", "text").collect()) == [("Reply to Ann about it", "followup"), ("pay the rent today", "reminder"), ("write the report", "todo")]


def test_shadow_keeps_to_its_budget(spark):
    from chronolake.operators import chunking as C

    got = spark.range(1).select(C.lexical_shadow(F.array(F.lit("My Alias")), F.lit("https://e.org/some"), F.repeat(F.lit("alpha bravo charlie delta "), 50), 40)).first()[0]
    assert got == "my alias e org some alpha bravo charlie"


def test_shortest_path_of_many_hops(spark):
    adj = spark.createDataFrame([(i, i + 1, 0.5) for i in range(9)], "a long, b long, w double")
    assert [tuple(r) for r in G.shortest_path(adj, 0, 9).collect()] == [(9, 0.5, list(range(10)))]
    assert G.shortest_path(adj, 0, 99).count() == 0


def test_bridges_of_a_large_component(spark):
    ring = [(i, (i + 1) % 20) for i in range(20)]
    leaves = [(i % 10, 100 + i) for i in range(6000)]
    chain = [(19, 7000)] + [(7000 + i, 7001 + i) for i in range(30)]
    adj = spark.createDataFrame(ring + leaves + chain, "a long, b long")
    adj = adj.union(adj.select("b", "a"))
    nodes = adj.select(F.col("a").alias("id")).distinct()
    got = [r.id for r in G.bridges(nodes, adj, nodes.withColumn("component", F.lit(0))).collect()]
    assert sorted(got) == [*range(10), 19, *range(7000, 7030)]


def _all_pairs(rows, fits):
    return sorted({(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and fits(a, b)})


def test_related_pairs_come_once_and_are_not_shuffled(spark):
    from itertools import product

    rows = [(i, t, e) for i, (t, e) in enumerate(product(["s", "t", None], [["x"], ["x", "y"], ["y", "x", "x"], ["z", None], [None], [], None]))]
    rows += [(100, "s", ["y"]), (100, "t", ["x"]), (101, "s", ["y", "z"]), (101, "t", ["x"]), (None, "s", ["x"])]
    keys = {}
    for i, t, e in rows:
        keys.setdefault(i, set()).update((t, w) for w in e or [] if t is not None and w is not None)
    want = _all_pairs([(i, k) for i, k in keys.items() if i is not None], lambda a, b: a[1] & b[1])
    out = J.related(spark.createDataFrame(rows, "id long, topic string, entities array<string>"))
    assert sorted(map(tuple, out.collect())) == want
    assert not any(line.lstrip("+-: *").startswith("HashAggregate(keys=[a#") for line in out._jdf.queryExecution().toString().splitlines())
    many = spark.range(2500).selectExpr("id", "'t' as topic", "array('w') as entities")
    assert J.related(many).agg({"a": "count"}).first()[0] == 2500 * 2499 // 2


def test_contradictions_of_one_project_are_spread_over_tasks(spark):
    rows = [(1, "p", True), (2, "p", False), (2, "p", False), (3, None, True), (4, "p", None), (None, "p", False), (5, "q", True), (0, "q", False)]
    out = J.contradictions(spark.createDataFrame(rows, "id long, project string, neg boolean"), F.col("neg"))
    assert sorted(map(tuple, out.collect())) == [("p", 1, 1), ("p", 1, 2), ("p", 1, 2), ("q", 0, 5)]
    big = J.contradictions(spark.range(20000).coalesce(1).selectExpr("id", "cast(id % 1 as string) as project"), F.col("id") % 4 == 0)
    at = big.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in at) == 5000 * 15000 and max(r["count"] for r in at) < 5000 * 15000 // 2


def test_nearest_ranks_as_the_plain_join_does(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 17 - 8) / 3.0 for j in range(4)]) for i in range(90)]  # some repeat
    rows += [(100 + i, [1.0, 2.0, 0.5, -1.0]) for i in range(25)] + [(130 + i, [0.0] * 4) for i in range(14)] + [(100, [1.0, 2.0, 0.5, -1.0]), (120, [1.0, 0.0, 0.0, 3.0])]
    rows += [(150, [None, 1.0, 0.0, 0.0]), (151, [nan, 1.0, 0.0, 0.0]), (152, [inf, 1.0, 0.0, 0.0]), (153, []), (154, None), (155, [1.0]), (156, [2.0]), (None, [1.0] * 4), (160, []), (180, [2.0, 4.0, 1.0, -2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.where("id % 10 = 0 or id > 149")
    pairs = df.join(q.select(F.col("id").alias("qid"), F.col("embedding").alias("q")), (F.size("embedding") == F.size("q")) & (F.col("id") != F.col("qid")))
    pairs = pairs.select(F.col("qid").alias("id"), F.col("id").alias("peer"), V.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "peer"))).where("rank <= 5")
    for block, chunk in ((4096, 8192), (20, 7)):
        got = C.nearest(df, q, 5, block, chunk)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan
