from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolake.functions import text as X
from chronolake.functions import time as T
from chronolake.functions import url as L
from chronolake.functions import vector as V
from chronolake.operators import filters as P
from chronolake.operators import retrieval as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stems_and_plurals(spark):
    got = one(spark, *[X.stem(F.lit(w)) for w in ("stories", "running", "wanted", "boxes", "cats", "as")])
    assert tuple(got) == ("story", "runn", "want", "box", "cat", "as")
    assert tuple(one(spark, X.singular(F.lit("cities")), X.singular(F.lit("glass")), X.plural(F.lit("city")), X.plural(F.lit("cat")))) == ("city", "glas", "cities", "cats")


def test_pieces_of_words(spark):
    got = one(spark, X.drop_middle(F.lit("index")), X.prefix(F.lit("index"), 3), X.char_ngrams(F.lit("abcd"), 3), X.char_ngrams(F.lit("ab"), 3), X.trim_to(F.lit("a long text"), 6))
    assert tuple(got) == ("inex", "ind", ["abc", "bcd"], [], "a l...")


def test_lists_keep_the_first_spelling(spark):
    got = one(spark, X.merge_lists(F.array(F.lit("Rust"), F.lit(" ")), F.array(F.lit("rust "), F.lit("Go"))))
    assert got[0] == ["Rust", "Go"]


def test_scrub_and_mentions(spark):
    got = one(spark, X.scrub(F.lit("/home/ann/x mail ann@ex.org key ABCDEFGHIJKLMNOPQRSTUVWX1")), X.mentions(F.lit("see src/a.rs and https://e.org/x, fix #12"))["files"])
    assert got[0] == "~/x mail <email> key <token>"
    assert got[1] == ["src/a.rs"]


def test_empty_text(spark):
    e = F.lit("")
    assert tuple(one(spark, X.symbol_ratio(e), X.noise_score(e), F.size(X.words(e)), F.size(X.sentences(e)), X.jaccard(X.words(e), X.words(e)))) == (1.0, 1.0, 0, 0, 0.0)


def test_urls(spark):
    u = F.lit("https://me:pw@www.Ex.org:8080/a/B/?q=1#x")
    assert tuple(one(spark, L.domain(u), L.host_simple(u), L.canonical(u), L.path_segments(u), L.query_keys(u), L.merge_key(u))) == ("ex.org", "me:pw@www.Ex.org:8080", "https://me:pw@www.Ex.org:8080/a/B", ["a", "b"], ["q"], "ex.org/a/b")


@pytest.mark.parametrize("arg, bounds", [(None, (None, None)), (0, (datetime(1970, 1, 1), None)), ({"from": "2024-01-01", "to": "2024-01-02"}, (datetime(2024, 1, 1), datetime(2024, 1, 2)))])
def test_windows(arg, bounds):
    assert T.parse_window(arg) == bounds


def test_windows_that_end_first():
    with pytest.raises(ValueError):
        T.parse_window({"from": "2024-01-02", "to": "2024-01-01"})


def test_durations(spark):
    assert tuple(one(spark, *[T.human_duration(F.lit(m)) for m in (0.5, 59, 61)])) == ("under a minute", "59m", "1h 1m")


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, V.norm(a), V.cosine(a, a), V.cosine(a, z), V.l2_normalised(a), V.similarity(F.lit(5.0)), V.similarity(F.lit(float("nan"))), V.mean_pool(F.array(a, z, F.array(F.lit(1.0))), 2))
    assert got[0] == 5 and got[1] == pytest.approx(1) and got[2] == 0 and got[3] == pytest.approx([0.6, 0.8]) and got[4] == pytest.approx(1 / 6) and got[5] == 0 and got[6] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize(
    "app, title, url, text, decision",
    [("Bitwarden", "", "", "", "skip_storage"), ("Chrome", "Incognito", "", "", "skip_storage"), ("Chrome", "", "https://chase.com", "", "skip_storage"), ("Chrome", "Login", "", "", "skip_storage"), ("Code", "x", "", "my api_key=1", "redact"), ("Code", "x", None, None, "allow")],
)
def test_safety_gate(spark, app, title, url, text, decision):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, P.safety_gate(s(app), s(title), s(url), s(text)))[0] == decision


def test_surface_policy(spark):
    p = lambda u, app="Chrome": P.surface_policy(F.lit(app), F.lit(u))
    assert tuple(one(spark, p("https://e.org/search?q=x"), p("https://e.org/feed"), p("https://e.org/users/ann"), p("https://e.org/a"), p("https://e.org/feed", "Code"))) == ("skip_frame", "skip_frame", "url_only", "normal", "normal")


def test_profile():
    p = R.Profile("What is the latest 42 release notes")
    assert p.intent == "definition" and p.numbers == ["42"] and p.recent and p.primary == ["latest", "release", "notes"] and "note" in p.expanded
    assert R.keyword_variants("alpha beta gamma")[0] == "alpha beta gamma"


def test_plan_refinement():
    base = R.plan("notes related to Alpha and Beta")
    assert base["intent"] == "related_to" and base["hops"] == 2 and base["hints"] == ["Alpha", "Beta"] and base["routes"] == ["chunk", "vector", "keyword", "entity", "graph"]
    assert R.plan("continue the parser", "atlas")["seeds"] == ["Project", "Session", "Memory", "Task"] and R.plan("debug it", "atlas")["seeds"][-1] == "Project"
    assert R.refined(base, {"hops": 9, "window": None, "other": 1}) == base
