"""Token counts, source divergence and sequenced changes against the library, SQL and brute force."""

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from chronolake.llm import divergence, sequenced, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected_counts(pieces, rows):
    for i, text in rows:
        n = len(pieces.encode(text or ""))
        yield i, len((text or "").encode()), n, n > 4096


def test_token_counts_of_odd_texts(spark, pieces):
    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\r", "\t", "é", "é", "日", "本", " ", "▁", "<s>", "the", "ing", "\x00", "😀", "ﬁ", "</s>", "　", "\xa0", "(", ");", "{"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(2000)]
    rows += [(None, None), (7, ""), (7, ""), (8, "x" * 50_000), (9, " " * 500), (10, "日本" * 3000), (11, "word " * 20_000), (None, "same"), (None, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(-1), "n_bytes": F.lit("x")}).repartition(5)
    got = sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect()), key=str)
    assert got == sorted(expected_counts(pieces, rows), key=str)


def test_token_counts_without_frequent_ones(spark, pieces, sf, monkeypatch):
    """Tier one changes no count; worker tables that are emptied change none either."""
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = sorted(expected_counts(pieces, rows), key=str)
    assert sorted(map(tuple, token_counts.op11_token_counts(spark, sf).collect()), key=str) == expected
    monkeypatch.setattr(token_counts, "frequent", lambda texts, path: token_counts.Lengths(16))
    assert sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect()), key=str) == expected


def test_length_table_is_emptied(monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_counts._tokens, "_MOST_SLOTS", 1 << 17)
    t = token_counts.Lengths(16)
    for k in range(1, 200):
        h = np.arange(k * 1000, k * 1000 + 1000).astype(np.uint64)
        t.learn(h, np.full(1000, k, np.int32))
        assert (t.find(h) == k).all() and len(t.keys) <= 1 << 17


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert token_counts.count_tokens(none, MODEL).count() == 0
    assert divergence.audit(none).count() == 0
    changes = spark.createDataFrame([], "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double")
    assert sequenced.apply_changes(changes).count() == 0


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def audited(rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["text", "lang", "source"]).astype(object))
    con.execute("CREATE TABLE documents AS SELECT text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM given")
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.ORACLE})").fetchall())


@pytest.mark.parametrize("sizes", [(3, 4, 2), (4096, 16, 4)])
def test_divergence(spark, monkeypatch, sizes):
    """Many tiles, chunks and strips and few give the SQL's rows: null and empty texts, groups and langs without terms, a lang of one source, ties, repeated rows."""
    for name, n in zip(("CHUNK", "BLOCK", "STRIP"), sizes):
        monkeypatch.setattr(divergence, name, n)
    r, words = random.Random(1), ["a", "B", "b", "çA", "日本", "Zz", "q", "x1y", "", "K"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))) if r.random() > 0.1 else None, r.choice(["en", "de", None, ""]), r.choice([None, "s1", "s2", "s3", "s4"])) for _ in range(150)]
    rows += [("only once", "xx", f"g{i % 12}") for i in range(14)] + [(None, "zz", "p"), ("uniq", "zz", "q"), (None, "yy", "alone"), ("long " * 20_000, "en", "s1")]
    rows += [(" ".join(r.choice(words) + str(r.randint(0, 9)) + r.choice(words) for _ in range(20)), "big", f"g{i % 25}") for i in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("x"), "term": F.lit(1), "chunk": F.lit(2.0)}).repartition(5)
    assert sorted(map(tuple, divergence.audit(docs).select(*COLUMNS).collect())) == audited(rows)


def test_divergence_of_the_tables(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.op12_source_divergence(spark, sf).select(*COLUMNS).collect())) == audited(rows)


def test_shares_are_exact():
    import numpy as np

    for n, m in ((0, 1), (10**12, 3 * 10**12 + 7), (8 * 10**15 - 1, 8 * 10**15), (5, 10**15)):
        assert divergence.shares(np.array([n]), np.array([m]))[0] == 1 + 10**9 * (n + 1) // m


def brute_changes(rows):
    """The contract, row by row: change_id, client_id, status, batch, missed, city, cents, current."""
    rows, seqs, batches = set(rows), defaultdict(set), defaultdict(list)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {(c, s): k + 1 for c, x in seqs.items() for k, s in enumerate(sorted(x, key=lambda v: (v is not None, v or 0)))}
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if r[4] is not None and r[0] is not None and h % 11:
            day = (r[4].date() - dt.date(1970, 1, 1)).days + 2 * (h % 4)
            batches[min(8, max(1, 1 + math.floor((day - 19723) * 8 / 160)))].append((day, r[0], rank[r[1], r[2]], r[1], r[3], r[7], r[8]))
    clients, out, latest = {}, {}, None

    def apply(c, n, batch, missed):
        s = clients[c]
        _, change, op, city, balance = s["held"].pop(n)
        if op == "I":
            s["city"], s["balance"] = city, balance
        elif op == "U":
            s["city"] = s["city"] if city is None else city
            s["balance"] = s["balance"] if balance is None else balance
        elif op == "D":
            s["city"] = s["balance"] = None
        s["next"] = n + 1
        if s["last"] is not None:
            out[s["last"]][-1] = False
        s["last"] = change
        amount = s["balance"]
        out[change] = [change, c, "applied", batch, missed, s["city"], None if amount is None or not math.isfinite(amount) else math.floor(100 * amount + 0.5), op != "D"]

    def run(c, batch):
        while clients[c]["next"] in clients[c]["held"]:
            apply(c, clients[c]["next"], batch, 0)

    for batch in range(1, 10):
        for c, s in clients.items():
            while s["held"] and (batch == 9 or latest is not None and min(x[0] for x in s["held"].values()) + 5 <= latest):
                n = min(s["held"])
                apply(c, n, batch, n - s["next"])
                run(c, batch)
        for day, change, n, c, *values in sorted(batches[batch], key=lambda x: x[:2]):
            s = clients.setdefault(c, {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if n < s["next"] or n in s["held"]:
                out[change] = [change, c, "rejected", batch, 0, None, None, False]
            else:
                s["held"][n] = (day, change, *values)
                run(c, batch)
        for x in batches[batch]:
            latest = max(latest or x[0], x[0])
    return sorted(map(tuple, out.values()), key=str)


def test_changes_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/client_changes.parquet").collect()]
    got = sorted(map(tuple, sequenced.op13_sequenced_changes(spark, sf).collect()), key=str)
    assert got == brute_changes(rows)


def test_changes_in_small_pages(spark):
    """One hot client over many pages, ties of n, nulls in every column, repeated rows, a batch without rows, days out of range, clashing names."""
    r = random.Random(3)
    rows = []
    for i in range(700):
        client = 1 if r.random() < 0.4 else r.choice([None, 2, 3, 4, 5])
        day = r.choice([d for d in range(100) if not 40 <= d < 60])
        at = None if r.random() < 0.03 else dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=r.randint(0, 23))
        rows.append((i, client, None if r.random() < 0.02 else max(0, day * 4 + r.randint(-12, 12)), r.choice(["I", "U", "U", "U", "D", None, "X"]), at, None, "s", r.choice([None, "A", "B"]), r.choice([None, -0.005, 1.115, 2.5, float("inf"), 1e3])))
    rows += [(None, 1, 5, "I", dt.datetime(2024, 1, 9), "w", "s", "A", 1.0), (9001, 2, 1, "I", dt.datetime(2023, 12, 1), "w", "s", "A", 1.0), (9002, 2, 999, "D", dt.datetime(2025, 1, 1), "w", "s", "A", 1.0)]
    schema = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
    table = spark.createDataFrame(rows + rows[:100], schema).withColumns({"n": F.lit("x"), "batch": F.lit(1.0), "client": F.lit(3), "bucket": F.lit("y"), "due": F.lit(0)}).repartition(4)
    got = sorted(map(tuple, sequenced.apply_changes(table, page=8, cache=2).drop("n").collect()), key=str)
    assert got == brute_changes(rows)
