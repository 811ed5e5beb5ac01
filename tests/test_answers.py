"""Graphs, projects, staged search, packs, ledger, deltas and line rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from chronolake.functions import lines as L
from chronolake.functions import projects as P
from chronolake.operators import dispatch as D
from chronolake.operators import packs
from chronolake.operators import runtime_graph as G


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "files, text, title, url, expected",
    [
        (["/Users/ann/code/my-tool/src/main.rs"], "", "", None, "My Tool"),
        (["C:\\work\\abc\\lib\\x.dll"], "", "", None, "ABC"),
        (["src/main.rs", "/home/src/a", "/x/v1.2/src/y"], "", "", None, None),
        ([], "see docs/ and team_box/packages/y", "", None, "Team Box"),
        ([], "", "edit web-shop/tests/a.py", None, "Web Shop"),
        ([], "", "", "https://host.example/repos/deep_sea.git/x", "Deep Sea"),
        ([], "", "", "https://host.example/ann/tide/Pull/7", "TIDE"),
        ([], "", "", "https://host.example/ann/a.b/issues/7", None),
        (None, None, None, "", None),
    ],
)
def test_projects(spark, files, text, title, url, expected):
    df = spark.createDataFrame([(None, files, text, title, url)], "p string, f array<string>, x string, t string, u string")
    assert df.select(P.inferred(*[F.col(c) for c in "pfxtu"])).first()[0] == expected


def test_reach_prefers_few_hops_then_confidence(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "c", "x", 0.5), ("a", "d", "x", 0.4), ("d", "c", "x", 0.9), ("c", "e", "x", 1.0)], "source string, target string, edge_type string, confidence double")
    got = {r.id: (r.hops, r.confidence, r.path) for r in D.reach(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert got == {"b": (1, 0.9, ["a x b"]), "d": (1, 0.4, ["a x d"]), "c": (2, 0.5, ["a x b", "b x c"])}


def brute_graph(seeds, members, edges, hops):
    """Every seed, node by node."""
    adj, best = {}, {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    for seed, score in seeds.items():
        for start in {n for n, i in members if i == seed}:
            seen, front = {start: 1.0}, {start: 1.0}
            for _ in range(hops):
                step = {}
                for n, c in front.items():
                    for m, w in adj.get(n, []):
                        if m not in seen:
                            step[m] = max(step.get(m, 0), min(c, w))
                seen |= step
                front = step
                for n, c in step.items():
                    for m, i in members:
                        if m == n and i != seed:
                            best[i] = max(best.get(i, 0), min(1, 0.58 * score + 0.42 * c))
    return dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: D.GRAPH_HITS])


def test_graph_hits_of_every_seed(spark):
    seeds = {i: (i * 7 % 10) / 10 for i in range(8)}
    members = [(f"n{(i * 3 + k) % 9}", i) for i in range(40) for k in range(1 + i % 2)]
    edges = [(f"n{i}", f"n{(i * 2 + 1) % 9}", 0.3 + i / 20) for i in range(9) if i != (i * 2 + 1) % 9]
    got = D.graph_hits(
        spark.createDataFrame(list(seeds.items()), "id long, score double"), spark.createDataFrame(members, "node string, id long"), spark.createDataFrame([(a, b, "x", w) for a, b, w in edges], "source string, target string, edge_type string, confidence double"), 2
    ).collect()
    assert {r.id: round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in brute_graph(seeds, members, edges, 2).items()}


def test_a_failing_route_is_left_out(spark):
    rows, failed = spark.createDataFrame([(1, 0.5), (2, 0.4)], "id long, score double"), []
    seen = []
    out = D.dispatch(spark, ["graph", "vector", "odd", "broken"], {"vector": lambda: rows, "broken": lambda: rows.select("nothing")}, lambda seeds: seen.append(sorted(map(tuple, seeds.collect()))) or rows.where("id = 2"), failed)
    assert sorted((r.id, r.route) for r in out.collect()) == [(1, "vector"), (2, "graph"), (2, "vector")]
    assert failed == ["odd", "broken"] and seen == [[(1, 0.5), (2, 0.4)]]
    assert D.dispatch(spark, ["odd"], {}).count() == 0


def test_graph_of_empty_and_null_records(spark):
    schema = "id long, session string, project string, topic string, url string, files array<string>, decisions array<string>, errors array<string>, tools array<string>, happened string, mattered string, changed string, insight double, confidence double, related array<string>, context string"
    rows = [(1, None, None, None, None, None, None, None, None, None, None, None, 0.9, 0.9, None, None), (2, "s", "Proj", "", "", [], [], [], [], "", "", "", 5.0, -1.0, ["1", "2"], "Continues from 9")]
    nodes, edges = G.memory_graph(spark.createDataFrame(rows, schema))
    assert {(r.memory, r.kind) for r in nodes.collect()} == {(1, "Memory"), (1, "Session"), (2, "Memory"), (2, "Session"), (2, "Project")}
    assert ("Memory|9", "Memory|2", "FollowedBy") not in {(r.source, r.target, r.edge_type) for r in edges.collect()}  # .64 * .55 is under .4
    assert G.memory_graph(spark.createDataFrame([], schema))[0].count() == 0


def test_a_repeated_delta_changes_no_graph(spark, tmp_path):
    shape = "id long, title string, us long, memory long, project string, entities array<struct<id: string, name: string, kind: string, confidence: double>>, evidence array<struct<id: string, source_id: string, summary: string, snippet: string, us: long>>, errors array<string>, todos array<string>"
    rows = [(i, f"t{i}", i, i, "P" if i % 2 else None, [("e:1", "Tab" if i % 3 else "File", "file", 0.5)], [], ["Bad thing"], [""]) for i in range(10)]
    df = spark.createDataFrame(rows, shape)
    write = G.graph_sink(f"{tmp_path}/g")
    for k in (0, 1, 1, 0):
        write(df.where(F.col("id") % 2 == k), k)
    whole = [sorted(map(tuple, x.collect())) for x in G.merged_graph(*G.activity_graph(df))]
    assert [sorted(map(tuple, x.collect())) for x in G.graph_now(spark, f"{tmp_path}/g")] == whole
    G.compacted(spark, f"{tmp_path}/g", f"{tmp_path}/small")
    assert [sorted(map(tuple, x.collect())) for x in G.graph_now(spark, f"{tmp_path}/small")] == whole


def test_subscribers_are_told_once(spark, tmp_path):
    events = spark.createDataFrame([(i, i * 10, f"e{i}", "s", ["x"], []) for i in range(40)], "id long, us long, title string, summary string, entities array<string>, errors array<string>")
    told, who = packs.Subscribers(spark, f"{tmp_path}/s"), spark.createDataFrame([("a", None), ("b", 385)], "session string, since long")
    first = {r.session: r.events for r in told.deltas(0, who, events, 350).collect()}
    assert first == {"a": list(range(39, 15, -1)), "b": [39]}
    again = spark.createDataFrame([("a", None)], "session string, since long")
    for _ in range(2):
        assert [(r.since, r.events) for r in told.deltas(1, again, events, 390).collect()] == [(350, [39, 38, 37, 36])]
    assert told.deltas(2, again, events, 390).first()["events"] == []


def test_lines_of_apps(spark):
    drop = lambda app, x: one(spark, L._let(L.app_kind(F.lit(app)), lambda k: L.dropped(k, F.lit(x))))[0]
    assert drop("Safari", "Inbox 3") and not drop("Notes", "Inbox 3")
    assert drop("Notes", "src/a.rs b/c.ts d_e.json x") and not drop("VSCode", "src/a.rs b/c.ts d_e.json x")
    assert drop("Notes", "One · Two · Three") and drop("Notes", "A | B | C") and drop("Notes", "== --") and not drop("Chrome", "https://a.example")
    assert one(spark, L.noise(F.lit("Notes"), F.lit(None).cast("string")))[0] == 1.0


def test_compressed_spans(spark):
    text = "Decided: we must fix the blocker now. The plan needs a review by Tuesday, please. ok"
    spans = L.salient_spans(F.lit("Notes"), F.lit(text))
    got = [one(spark, L.compressed(spans, F.lit(text), n))[0] for n in (10, 200)]
    ranked = [r["text"] for r in one(spark, spans)[0]]
    assert got == [ranked[0][:10], " • ".join(ranked)]
    assert one(spark, L.compressed(spans, F.lit(text), len(ranked[0]) + 1))[0] == ranked[0] + " • "
    assert one(spark, L.compressed(L.salient_spans(F.lit(""), F.lit("")), F.lit(""), 5), F.size(L.salient_spans(F.lit(""), F.lit(None).cast("string"))))[:] == ("", 0)
