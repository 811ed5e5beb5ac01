"""Steps that failed at size: results on odd rows against a plain rule, and plans without the costly part."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from chronolake.functions import lines as L
from chronolake.functions import text as X
from chronolake.llm import line_dedup as D
from chronolake.operators import chunking as C
from chronolake.operators import graph
from chronolake.operators import joins as J
from chronolake.operators import retrieval as R
from chronolake.operators import runtime_graph as G
from chronolake.operators import windows as W
from chronolake.streaming import batch as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_in_one_pass(spark):
    random.seed(3)
    rows = [(i, random.choice([None, *range(40)]) and 1_700_000_000_000_000 + random.randrange(90) * 60_000_000, random.choice("abc")) for i in range(600)] + [(1000, None, "none")]
    df = spark.createDataFrame(rows, "id long, us long, k string")
    want, last = [], {}
    for us, i, k in sorted((us, i, k) for i, us, k in rows if us is not None):
        if k not in last or us - last[k] > 600_000_000:
            last[k] = us
            want.append(i)
    out = B.tumbling_dedup(df, ["k"], 600)
    assert sorted(r.id for r in out.collect()) == sorted(want)
    groups = W.anchored_groups(df.where("us is not null"), "k", 5)
    assert "FlatMapGroups" not in plan(out) + plan(groups)  # no call for each small group


def test_bm25_and_coverage_without_stems(spark):
    p = R.Profile("running studies boxes 42 of the red")
    texts = ["Running STUDIES, boxes", "run studied box 42", "study study studies; red-reds", "", "xrunning running's", "the red running 420", "éstudies ties tie", "boxe boxes boxs boxing"]
    docs = R.with_text(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), F.col("text"))
    both = docs.select("id", R.coverage(p, F.col("toks")).alias("a"), R.text_coverage(p, F.col("norm")).alias("b"), R.phrase_alignment(p, F.col("norm"), F.col("pairs")).alias("c"), R.phrase_alignment(p, F.col("norm")).alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in both.collect())
    got = {r.id: r for r in docs.collect()}
    want = {t: {i: sum(w == t for w in r.wordlist) + sum(s == t for s in r.stems) for i, r in ((r.id, r) for r in docs.withColumn("stems", F.transform("wordlist", X.stem)).collect())} for t in p.expanded}
    out = R.bm25(docs, p)
    assert "stem" not in plan(out) and plan(out.where("bm25 > 0")).count("[^\\p{L}\\p{N}]+") <= 2  # the text is normalised once for the statistics and once for the scores
    for r in out.collect():
        assert (r.bm25 > 0) == (any(want[t][r.id] for t in p.expanded) or any(x in got[r.id].pairs for x in ("running studies", "studies boxes", "the red")))


def test_lines_are_rated_once(spark):
    one = spark.range(1).select(F.lit("Google Chrome").alias("app"), F.lit(" a\t b\x0b\n\n  (x/y), z\\w c.rs d_e.f \n[LOW_CONF] Hello  there, good people of the town\n").alias("text"))
    out = one.select(L.high_signal(F.col("app"), F.col("text")).alias("h"), L.noise(F.col("app"), F.col("text")).alias("n"), F.col("app"))
    row = out.first()
    assert (row.h.text, row.h.total, row.h.kept, row.h.low, row.h.noise, row.n) == ("Hello there, good people of the town", 3, 1, 1, 2, 2 / 3)
    rule = spark.range(1).select(L.dropped(L.app_kind(F.lit("x")), F.col("id").cast("string")).alias("d"))
    assert rule._jdf.queryExecution().analyzed().toString().count("[\\p{L}\\p{N}\\s]+") == 1


def test_chunks_of_a_long_text():
    text = "\n".join(f"line {i} about the matter {i * 7919 % 100_003} and some more words of it" for i in range(160_000))
    start = time.time()
    parts = C.chunks("t", text)
    assert len(parts) > 10_000 and time.time() - start < 20  # each chunk was compared with all before it


def test_chunks_come_in_small_batches(spark):
    df = spark.range(1000, numPartitions=1).select("id", F.lit("t").alias("t"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("some words of row "), F.col("id").cast("string"))).alias("x"))
    out = C.chunked(df, "id", "t", "x")
    assert "MapInArrow" in plan(out) and {r.id for r in out.collect()} >= {i for i in range(1000) if i % 3}


def test_activity_parts_alone(spark, tmp_path):
    entity = lambda *v: "named_struct('id', {}, 'name', {}, 'kind', {}, 'confidence', {})".format(*v)
    item = "array(" + ", ".join([entity("'e'", "'Window'", "'file'", "0.1D"), entity("'f'", "'Note'", "'file'", "0.9D"), entity("'g'", "string(NULL)", "'x'", "0.1D"), entity("'h'", "'Tab'", "string(NULL)", "0.8D")]) + ")"
    df = spark.sql(f"SELECT id, 'T' AS title, id * 10 AS us, id AS memory, IF(id = 1, NULL, 'A b') AS project, {item} AS entities, array(struct(' ' AS id, 'S 1' AS source_id, '' AS summary, 'told' AS snippet, 5L AS us)) AS evidence, array(' ', 'Oh no') AS errors, array('Do it') AS todos FROM range(2)")
    nodes, edges = G.merged_graph(*G.activity_graph(df))
    assert "transform(entities" not in str(edges._jdf.queryExecution().analyzed()) or "regexp_replace(regexp_replace(lower(trim(lambda" not in str(edges._jdf.queryExecution().analyzed())  # keys are made in rows, not in arrays
    want = {("activity:0", t, k) for t, k in (("memory:0", "ResultedIn"), ("project:a:b", "BelongsTo"), ("f", "EditedFile"), ("h", "MentionedIn"), ("evidence:0:s:1", "InformedBy"), ("blocker:oh:no", "BlockedBy"), ("todo:do:it", "ResultedIn"))}
    assert {tuple(r)[:3] for r in edges.where("source = 'activity:0'").collect()} == want
    assert {(r.id, r.kind, r.label, r.n) for r in nodes.where("id not like 'activity%'").collect()} == {("project:a:b", "Project", "A b", 1), ("f", "File", "Note", 2), ("h", "Entity", "Tab", 2), ("evidence:0:s:1", "Entity", "told", 1), ("evidence:1:s:1", "Entity", "told", 1), ("blocker:oh:no", "Error", "Oh no", 2), ("todo:do:it", "Task", "Do it", 2)}
    G.graph_sink(str(tmp_path), ("edges",))(df, 0)
    assert [p.name for p in tmp_path.iterdir()] == ["edges"]
    assert {tuple(r) for r in G.graph_now(spark, str(tmp_path), ("edges",))[0].collect()} == {tuple(r) for r in edges.collect()}


def test_every_pair_under_a_key_is_met(spark):
    random.seed(5)
    rows = [(k, h, 100, 40, h % 3) for k in (1, 2) for h in random.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "k long, h long, len int, n long, label long")
    texts = spark.range(60).select(F.col("id").alias("h"), F.lit("abc").alias("line")).select("h", "line", *[c.alias(n) for n, c in D.letter_counts().items()])
    want = {(min(a, b), max(a, b)) for k, a, *_ in rows for j, b, *_ in rows if k == j and a % 3 != b % 3}
    assert {tuple(r) for r in D.every_pair(df, texts, 0.9, block=7).collect()} == want


def test_grams_rule_out_other_words_of_the_same_letters(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghiklmnoprstu") for _ in range(random.randrange(2, 9)))

    def edited(x, n):
        for _ in range(n):
            at, how = random.randrange(len(x)), random.randrange(3)
            x = x[:at] + ("" if how == 0 else random.choice("xyz")) + x[at + (how < 2) :]
        return x

    lines, near, other = [" ".join(word() for _ in range(n)) for n in (1, 2, 5, 20, 40, 60, 110)], [], []
    for x in [*lines, "abc", "ab", "éñ ß漢字 " * 9]:
        for _ in range(20):
            y = edited(x, int(len(x) * 0.1 + 1e-9))
            near.append((x, y))
        other.append((x, "".join(random.sample(x, len(x)))))
    texts = list(dict.fromkeys(t for pair in [*near, *other] for t in pair))
    docs = spark.createDataFrame(list(enumerate(texts)), "h long, line string").withColumn("len", F.length("line"))
    table = docs.select("h", "line", "len", *[c.alias(n) for n, c in D.letter_counts().items()])
    pairs = [(k, t) for k, pair in enumerate([*near, *other]) for t in pair]
    rows = spark.createDataFrame([(k, texts.index(t), len(t), 2, texts.index(t)) for k, t in pairs], "k long, h long, len int, n long, label long")
    met = {tuple(sorted((texts[r.a], texts[r.b]))) for r in D.every_pair(rows, table, 0.9).collect()}
    want = {tuple(sorted(p)) for p in near if p[0] != p[1]}
    assert want <= met and len(want) > 100
    assert not met & {tuple(sorted(p)) for p in other if 20 < len(p[0]) <= D.GRAM_CHARS}  # these were compared as texts


def test_lines_that_lead_no_key_are_linked(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghiknoprstuvw") for _ in range(7))
    shared = [word() for _ in range(4)]  # a passage that many different lines hold
    lines = [" ".join([*shared, *[word() for _ in range(9)]]) for _ in range(60)]
    near = [x[:-1] + ("z" if x[-1] != "z" else "y") for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")
    ids = {r.doc_id for r in D.dedup_lines(docs).where("n_removed > 0").collect()}
    assert ids == set(range(60, 120))


def test_issues_make_each_text_once(spark, sf):
    from chronolake.plans import catalog

    out = catalog.queries()["f27_quality_issues"](spark, sf)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") <= 6  # three texts, each at most twice: in the filter and in the list
    assert "Exchange hashpartitioning(p_partkey" in plan(out)  # all tasks share the rows of a file of one row group


def test_labels_of_records_are_made_once(spark, sf):
    from chronolake.plans import graph_queries as Q

    rows = Q.records(spark, sf)
    assert "hashpartitioning(p_partkey" in rows._jdf.queryExecution().executedPlan().toString()  # all tasks share the rows of a file of one row group
    odd = rows.limit(1).withColumns({"session": F.lit(" \t\t "), "topic": F.lit("a \t b  c"), "url": F.lit("x//\n \n \nab")})
    got = {(r.kind, r.label) for r in G.memory_graph(odd)[0].collect()}
    assert ("Concept", "a b c") in got and ("Session", "session  \t\t ") in got and all(k != "Url" or len(v.split()) == 1 for k, v in got)


def test_pagerank_carries_one_of_equal_leaves(spark, monkeypatch):
    random.seed(2)
    nodes = spark.range(60).union(spark.range(1000, 1300))
    ends = [(random.randrange(40), random.randrange(40), random.choice([0.5, 1.0])) for _ in range(120)] + [(x, random.randrange(12), 0.9) for x in range(1000, 1300)] + [(50, 51, 0.4), (7, 7, 0.3), (1, 99, 0.8), (98, 2, 0.7)]
    links = ends + [(b, a, w) for a, b, w in ends]
    adj, ids = spark.createDataFrame(links, "a long, b long, w double"), [r.id for r in nodes.collect()]
    adj = adj.withColumn("w", F.when((F.col("a") == 3) & (F.col("b") > 20), F.lit(None)).otherwise(F.col("w")))
    rows = [tuple(r) for r in adj.collect()]
    total, r = {}, dict.fromkeys(ids, 1 / 360)
    for a, _, w in rows:
        total[a] = total.get(a, 0) + (w or 0)
    for _ in range(7):
        got = dict.fromkeys(ids, 0.15 / 360)
        for a, b, w in rows:
            if a in r and b in r and w:
                got[a] += 0.85 * w / total[a] * r[b]
        r = got
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: sizes.append((out.columns, out.count())) or out)(cut(df)))
    out = {x.id: x.r for x in graph.pagerank(nodes, adj, rounds=7).collect()}
    assert out.keys() == r.keys() and max(abs(out[i] - r[i]) for i in r) < 1e-12
    assert max(n for c, n in sizes if c == ["id", "r"]) <= 60 + 12  # a round carries one leaf of each neighbour


def test_pairs_under_a_key_meet_by_length(spark):
    random.seed(4)
    lines = ["".join(random.choice("aeiou nrtsx") for _ in range(random.randrange(10, 90))) for _ in range(150)] + ["a" * 3000, "a" * 3100 + "e" * 40]
    df = spark.createDataFrame([(7, h, len(x), 152, h % 5) for h, x in enumerate(lines)] + [(8, h, 20, 3, 1) for h in range(3)], "k long, h long, len int, n long, label long")
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string").select("h", "line", F.length("line").alias("len"), *[c.alias(n) for n, c in D.letter_counts().items()])
    most = D.MOST_LETTERS

    def apart(x, y):
        d = [min(x.count(c), most) - min(y.count(c), most) for c in D.LETTERS]
        return max(sum(v for v in d if v > 0), -sum(v for v in d if v < 0))

    want = {(a, b) for b, y in enumerate(lines) for a, x in enumerate(lines[:b]) if a % 5 != b % 5 and abs(len(x) - len(y)) <= (far := int(0.1 * max(len(x), len(y)) + 1e-9)) and apart(x, y) <= far}
    out = D.every_pair(df, texts, 0.9, block=20)
    assert {tuple(r) for r in out.collect()} == want and (150, 151) in want and len(want) > 10
    assert out.count() == len(want)  # each pair under a key once
    assert "[k#" in plan(out) and "part#" in next(x for x in plan(out).splitlines() if "Join" in x and "part#" in x)  # lines far apart in length do not meet
    got = {tuple(r) for r in D.verified(out, texts, 0.9).collect()}
    assert got == {(r.a, r.b) for r in out.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b").where("levenshtein(x, y) <= floor(0.1 * greatest(length(x), length(y)) + 1e-9)").collect()}


def test_classifier_needs_little_memory_beside_others():
    import tracemalloc

    import pyarrow as pa

    from chronolake.llm import _tokens, quality

    random.seed(1)
    texts = [" ".join(random.choice("abcdefgh") * random.randrange(1, 9) for _ in range(300)) for _ in range(3000)]
    table = pa.table({"doc_id": pa.array(range(3000)), "text": texts, "quality": pa.array([i % 2 for i in range(3000)]), "turn": pa.array(range(3000))})
    peaks = []
    for work in (lambda: quality._fit(table), lambda: list(quality._score(np.zeros((1 << quality.BITS) + 1))(iter(table.select(["doc_id", "text"]).to_batches())))):
        _tokens._KEPT["x"] = "an encoder of a stage before"
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert not _tokens._KEPT
    assert peaks[0] < 32 and peaks[1] < 18, peaks


def test_contradictions_meet_in_small_blocks(spark):
    rows = [(i if i else None, "p", i % 3 == 0) for i in range(1500)] + [(5000, None, True), (5001, "q", True), (5002, "q", None)]
    df = spark.createDataFrame(rows, "id long, project string, neg boolean")
    blocks = J._blocks(df.where("project = 'p'"), ["project"])
    assert dict(blocks.dtypes)["ids"] == "array<bigint>" and blocks.agg(F.max(F.size("ids"))).first()[0] < 400  # all pairs of two blocks are in memory at once
    assert blocks.select(F.explode("ids").alias("i")).agg(F.count("*"), F.count("i")).first()[:] == (1500, 1499)
    got = J.contradictions(df, F.col("neg")).collect()
    least = lambda a, b: (a if b is None else b if a is None else min(a, b), b if a is None else a if b is None else max(a, b))
    assert sorted((r.a, r.b) for r in got) == sorted(least(a[0], b[0]) for a in rows[:1500] if a[2] for b in rows[:1500] if not b[2])


def test_related_blocks_are_sent_a_few_times(spark):
    side = lambda c, n: spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias(f"{c}_block"), F.lit(0).alias(f"{c}_name"))
    met = J._paired(side("x", 40), side("y", 30), "k", 8, side=3)
    assert met.count() == 1200 and met.select("x_block", "y_block").distinct().count() == 1200
    assert {tuple(r) for r in met.groupBy("x_block").agg(F.countDistinct("down", "across")).select("count(DISTINCT down, across)").distinct().collect()} <= {(1,), (2,), (3,)}  # was 16 tasks for each block of y
    pages = spark.createDataFrame([(i, f"t{i % 2}", [f"e{i % 5}", f"e{i % 3}", None]) for i in range(700)], "id long, topic string, entities array<string>")
    rows = [(r.id, r.topic, {*r.entities} - {None}) for r in pages.collect()]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] & b[2])
    assert sorted(map(tuple, J.related(pages).collect())) == want
