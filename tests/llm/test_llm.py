"""Training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from chronolake.llm import _tokens, decontam, html_extract, jaccard, line_dedup, packing, quality, rans, sharding, substring_dedup, topk_bsi
from chronolake.llm import _text as T
from chronolake.llm._graph import components, forest
from chronolake.llm._work import folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
P = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, P + " tail one", "x"),
    (2, "intro two " + P, "x"),
    (3, P + " tail one", None),
    (3, P + " tail one", None),
    (4, "", "y"),
    (5, None, "y"),
    (None, P, "z"),
    (6, "a\tb\n c\x0bd e", "z"),
    (7, "short", "z"),
    (8, "short", "z"),
    (9, "very " * 30_000 + "long", "z"),
    (10, "!!! ???\n\n---", "z"),
]
SCHEMA = "doc_id long, text string, class string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnsRenamed({"class": "class"}).withColumns({"h": F.lit(1), "n": F.lit("x"), "rng": F.lit(2.0), "n_removed": F.lit(7)}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_windows(rows, width):
    seen, words = {}, [(i, re.findall("[^\x20\x09-\x0d]+", x or "")) for i, x in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            if i is not None and (t not in seen or i < seen[t]):
                seen[t] = i
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and seen[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_substrings(docs, block_bytes):
    got = substring_dedup.substring_dedup(docs, block_bytes=block_bytes).collect()
    expected = Counter(brute_windows([r[:2] for r in ROWS], 13))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == expected
    assert all(sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed for r in got)


def test_substrings_of_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substring_dedup.op1_substring_dedup(spark, sf).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_windows(rows, 13)}


@pytest.mark.parametrize("f", [lambda d: substring_dedup.substring_dedup(d), lambda d: jaccard.near_duplicates(d), lambda d: line_dedup.dedup_lines(d), lambda d: packing.pack(d, WORD), lambda d: sharding.shard(d), lambda d: quality.classify(d, np.zeros((1 << quality.BITS) + 1))])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0


def test_empty_tables_of_pairs(spark, empty):
    items = spark.createDataFrame([(1, P)], "item_id long, text string")
    assert decontam.contaminated(empty, items).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_bsi.top_k(v, v).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages, html_extract.train(pages)).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    got = quality.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert quality.keep_good(docs, np.zeros((1 << quality.BITS) + 1), 0.4).columns == docs.columns


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [400_000.0, 0.0]), (2, [500_000.0, -3e6]), (3, [-7e6, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r["rank"], r.score) for r in topk_bsi.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == {2: (1, 64 * 64 * 500_000), 1: (2, 64 * 64 * 400_000), 3: (3, -64 * 64 * 7_000_000)}


def brute_top(rows, k):
    x = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)]
    for i, q in x:
        if i % 20 == 0:
            found = sorted((-int(q @ v), j) for j, v in x if j != i and len(v) == len(q))[:k]
            yield from ((i, n + 1, j, -s) for n, (s, j) in enumerate(found))


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(e)) for e in r.normal(0, 0.3, 7)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(50)] + [(500, None), (520, []), (540, [None] * 7), (560, [float("nan")] * 7), (580, [float("inf")] * 7), (600, [1.0, 2.0]), (620, [3.0, -1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_bsi.top_k(df, df.where("vec_id % 20 = 0"), 9, block_rows=100, chunk_queries=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 9))


@pytest.mark.parametrize("shards", [1, 8])
def test_shards(spark, docs, shards):
    big = docs.select("doc_id", "text").union(spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one very common text")).otherwise(F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int"))).alias("text")))
    got = sharding.shard(big.where("doc_id is null or doc_id <> 9"), shards).collect()
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(ROWS) - 1 + 2000
    mean = sum(size.values()) / shards
    assert all(abs(v - mean) < 0.05 * mean for v in size.values())
    assert {r.size for r in got if r.doc_id == 5} == {1}
    assert max(map(len, where.values())) <= max(1, shards)


def test_ranges_fit_the_last_cuts(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("size"), F.lit(1).cast("long").alias("text_crc32"), F.lit(7).cast("long").alias("h"))
    cuts, stats = sharding.splitters(rows, 27_000, 64, rounds=1)
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    assert len(cuts) > 1 and {r.rng: r.n for r in stats} == Counter(next(sharding._ranges(cuts)([batch])).column("rng").to_pylist())


def test_template_matches(spark):
    text = "Tom buys 12 apples for 30 dollars and gives 12 apples to Anna every single week of the year."
    d = [(1, "Well. " + text), (2, text.replace("12", "15").replace("30", "45").replace("Anna", "Maria")), (3, text.replace("12", "15", 1).replace("30", "45")), (4, "Tom buys nothing at all here, ever, no matter what the week of the year may be"), (5, None), (None, text), (6, text.upper())]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, None), (9, "a b"), (None, text), (10, text)], "item_id long, text string")
    got = decontam.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 7), (1, 10), (2, 7), (2, 10)}
    assert {r.doc_id for r in got} <= {1, 2, 6}
    assert {r.same_values for r in got if r.doc_id == 1} == {True} and {r.same_values for r in got if r.doc_id == 2} == {False}


def test_copies_of_numeric_items(spark):
    sums = ["What is 12 * (7 + 5) - 9 / 3?", "Let x = 3. Compute 4 + 5 * 6 - 7 + 8 * 9 - 10."]
    mixed = "Tom buys 12 apples and pays for them with cash. Then 3 4 5 6 7 8 9 10 11 12 13 14."
    d = [(1, "He asked: " + sums[0] + " Nobody knew."), (2, "so " + sums[1]), (3, sums[1].replace("4", "2")), (4, "What is 13 * (7 + 5) - 9 / 3?"), (5, mixed.replace("12 apples", "15 apples").replace(" 3 4 5", " 1 1 1")), (6, mixed)]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    items = spark.createDataFrame([(1, sums[0]), (2, sums[1]), (3, mixed)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 1), (2, 2), (5, 3), (6, 3)}


def test_benchmark_in_the_tables(spark, sf):
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    parts = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        parts |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    leaked = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(tuple(w[i : i + 13]) in parts for w in [words(r.text)] for i in range(len(w) - 12))}
    assert {r.doc_id for r in decontam.op5_benchmark_decontamination(spark, sf).collect()} == leaked


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, spark, sf):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    odd = ["", " ", "  a", "a  b", "x \n y", "é  b", "it's  don't\n\nx", "trail ", "a\tb", "日本 語", "<|endoftext|> hi", "hi <|endoftext|> there", "x<|startoftext|>y  <|endoftext|>\nz", "é ́x", "a\r\nb", "x\x85 y", "İ Σ", "　 　a b"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    e = _tokens.Encoder(path)
    data, off = T.buffers(pa.array(texts))
    got = []
    for i, j in T.chunks(off, 1 << 14):
        ids, first = e.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
        got += [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    assert got == [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 2047, 2049, 300_000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50_257
    c = rans.Coder(rans.frequencies(np.bincount(ids, minlength=50_257)))
    block = c.encode(ids)
    assert (c.decode(block) == ids).all()
    if n > 1000:
        rows = -(-n // rans.LANES)
        parts = [c.decode(block, p) for p in range(-(-rows // rans.CHECK_ROWS))]
        assert (np.concatenate(parts) == ids).all()
        with pytest.raises(ValueError, match="checksum"):
            c.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    at = f"file://{tmp_path}/ids"
    rans.write_tokens(docs, at, BYTE, range_bytes=4000, block_ids=500)
    got = sorted(rans.read_tokens(spark, at, with_ids=True).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(BYTE)
    rows = sorted([(r[0], r[1]) for r in ROWS], key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    begin = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, begin, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        begin += len(ids)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, 64).collect()
    expected = Counter()
    for i, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 64)):
            z = ids[a : a + 64]
            expected[i, n, a, len(z), zlib.crc32(np.array(z, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_packing(got, 64)


def check_packing(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_is_tight(spark, sf):
    got = packing.op9_best_fit_packing(spark, sf).collect()
    assert check_packing(got, 2048) <= 1 + 1.02 * sum(r.length for r in got) / 2048


def test_plan_equals_best_fit_decreasing():
    lengths = np.random.default_rng(3).integers(1, 101, 500)
    _, n = packing.plan(np.bincount(lengths, minlength=101), 100)
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(100 - x)
    assert n == len(gaps)


def brute_near(rows):
    word = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    sets = []
    for _, x in rows:
        w = word.findall((x or "").lower())
        sets.append(set() if x is None else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {("raw", x)})
    link = [[j for j, b in enumerate(sets) if j != i and a and len(a & b) * 5 >= 4 * len(a | b)] for i, a in enumerate(sets)]
    label, out = {}, []
    for i in range(len(rows)):
        if i not in label:
            todo, group = [i], [i]
            label[i] = i
            while todo:
                for v in link[todo.pop()]:
                    if v not in label:
                        label[v] = i
                        todo.append(v)
                        group.append(v)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            for g in group:
                out.append((rows[g][0], min(ids) if ids else None, len(link[g])))
    return Counter(out)


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_duplicates(spark, chunk):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 9999, 120)]
    rows = [r[:2] for r in ROWS]
    for i in range(30):
        w = list(base)
        for k in r.integers(0, 120, i % 6):
            w[k] = "changed"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit(1), "comp": F.lit("x")})
    got = jaccard.near_duplicates(df, chunk=chunk).collect()
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in got) == brute_near(rows)


def test_copies_without_doc_id(spark):
    df = spark.createDataFrame([(None, "one text here"), (6, "one text here"), (5, "one text here")], "doc_id long, text string")
    assert {(x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(df).collect()} == {(None, 5, 2), (6, 5, 2), (5, 5, 2)}


def test_least_matches_rise():
    k = jaccard.least_matches(0.8, 1e-6)
    assert list(k) == sorted(k) and 0 < k[-1] < 0.8 * jaccard.HASHES


def test_lines(spark):
    long = " ".join(f"token{i}" for i in range(60))
    rows = [
        (1, "Same line here.\nunique one\n---\n" + long, 5),
        (2, "same LINE here!\n---\nanother thing\n" + long.replace("token30", "other"), 6),
        (3, None, 7),
        (4, "", 8),
        (5, "same line here", 9),
        (5, "same line here", 9),
        (None, "unique one\nlast", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int").withColumns({"idx": F.lit("i"), "h": F.lit(3)})
    got = line_dedup.dedup_lines(df).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == 7 and df.columns[3:] == ["idx", "h"] and {r.idx for r in got} == {"i"}
    assert text[None] == "unique one\nlast" and text[1] == "Same line here.\n---\n" + long
    assert text[2] == "---\nanother thing" and text[3] is None and text[4] == "" and text[5] == ""
    assert sum(r.n_removed for r in got) == 5


def similar_pairs(n, kind, count=150):
    """Pairs of lines of n words, of edit similarity 0.9 or more: one letter changed, or typos in one word of seven, or one word of about a tenth of the line replaced."""
    r = np.random.default_rng([n, len(kind)])
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda k: "".join(r.choice(letters, k))
    out = []
    for _ in range(count):
        words = [word(k) for k in r.integers(3, 10, n)]
        line = " ".join(words)
        most = len(line) // 10
        other = list(words)
        hit = r.permutation(n)[: {"letter": 1, "typos": max(1, n // 7), "word": 1}[kind]]
        for i in hit:
            if kind == "word":
                k = min(len(words[i]), most)
                other[i] = word(k) + words[i][k:]
            else:
                at = r.integers(len(words[i]))
                other[i] = words[i][:at] + "9" + words[i][at + 1 :]
        out.append((line, " ".join(other)))
    return out


def longer_pairs(n, kind, count=100):
    """Pairs of lines of n words of other lengths: a letter more, a short word more, a word split, two joined. Every second pair has a border of the length parts between its lengths."""
    r = np.random.default_rng([n, *map(ord, kind)])
    letters = list("abcdefghijklmnopqrstuvwxyz")
    part = lambda x: int(np.floor(5 * np.log(len(x))))
    out = []
    while len(out) < count:
        words = ["".join(r.choice(letters, k)) for k in r.integers(3, 10, n)]
        line, i = " ".join(words), int(r.integers(n - 1))
        at = int(r.integers(1, len(words[i])))
        if kind == "letter":
            words[i] = words[i][:at] + "z" + words[i][at:]
        elif kind == "word":
            words.insert(i, "".join(r.choice(letters, max(1, min(6, len(line) // 10 - 1)))))
        elif kind == "split":
            words[i] = words[i][:at] + " " + words[i][at:]
        else:
            words[i : i + 2] = [words[i] + words[i + 1]]
        other = " ".join(words)
        if len(out) % 2 or part(line) != part(other):
            out.append((line, other))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_recall_of_lines_of_other_lengths(spark):
    """Against brute-force edit similarity, at 8, 12, 20 and 40 words, half of the pairs across a border of the length parts."""
    pairs = {(n, kind): longer_pairs(n, kind) for n in (8, 12, 20, 40) for kind in ("letter", "word", "split", "joined")}
    sure = {key: [(a, b) for a, b in each if 10 * edits(a, b) <= max(len(a), len(b))] for key, each in pairs.items()}
    rows, where = [], {}
    for key, each in sure.items():
        for a, b in each:
            rows += [(2 * len(rows), a), (2 * len(rows) + 1, b)]
            where[rows[-1][0]] = key
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    found = Counter(where[i] for i in gone)
    recall = {key: found[key] / len(each) for key, each in sure.items()}
    print(recall)
    assert all(len(each) > 70 for each in sure.values()) and min(recall.values()) >= 0.9, recall


def test_recall_of_similar_lines(spark):
    """Against brute-force edit similarity, at 5, 10, 20 and 40 words."""
    pairs = {(n, kind): similar_pairs(n, kind) for n in (5, 10, 20, 40) for kind in ("letter", "typos", "word")}
    sure = {key: [(a, b) for a, b in each if 10 * edits(a, b) <= max(len(a), len(b))] for key, each in pairs.items()}
    rows, where = [], {}
    for key, each in sure.items():
        for a, b in each:
            rows += [(2 * len(rows), a), (2 * len(rows) + 1, b)]
            where[rows[-1][0]] = key
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    found = Counter(where[i] for i in gone)
    recall = {key: found[key] / len(each) for key, each in sure.items()}
    print(recall)
    assert all(len(each) > 100 for each in sure.values()) and min(recall.values()) >= 0.95, recall


def test_one_measure_at_every_length(spark):
    words = [f"steady{chr(97 + i)}{chr(99 + i)}" for i in range(20)]
    typos = [w[:3] + "9" + w[4:] if i in (4, 9, 15) else w for i, w in enumerate(words)]
    short = ["ab", "cd"] * 9
    two = short + ["internationalisation", "characteristically"], short + ["q" * 20, "z" * 18]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(typos)), (3, " ".join(two[0])), (4, " ".join(two[1]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_edit_bound(spark):
    """The shortened comparison decides as brute force does."""
    r = np.random.default_rng(11)
    rows = []
    for _ in range(300):
        words = ["".join(r.choice(list("abcü"), r.integers(1, 5))) for _ in range(r.integers(0, 9))]
        other = [w for w in words if r.random() > 0.1]
        for _ in range(r.integers(0, 3)):
            other.insert(r.integers(len(other) + 1), str(r.choice(["a", "bb", "cüc", "x"])))
        if r.random() < 0.2:
            r.shuffle(other)
        rows.append((" ".join(words), " ".join(other), int(r.integers(0, 8))))
    df = spark.createDataFrame(rows, "x string, y string, most int")
    args = F.col("x"), F.col("y"), F.col("most")
    got = df.select("x", "y", "most", line_dedup.within(*args).alias("near"), line_dedup.recurring(*args).alias("may"), line_dedup._by_place(*args).alias("place")).collect()
    assert all(g.near == (edits(g.x, g.y) <= g.most) for g in got) and {g.near for g in got} == {True, False}
    assert all(g.may or not g.near for g in got) and not all(g.may for g in got)
    assert all(g.place is None or g.place >= edits(g.x, g.y) for g in got) and any(g.place is not None and g.near for g in got)


def test_components(spark):
    r = np.random.default_rng(8)
    a, b = r.integers(0, 200, 150), r.integers(0, 200, 150)
    label = forest(200, a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")).collect()}
    assert got == {i: int(label[i]) for i in got} and set(got) == {int(i) for x, y in zip(a, b) if x != y for i in (x, y)}


def test_extraction(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")

    def plain(x):
        body = re.search(r"<article>(.*?)</article>", x, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
        return "\n".join(y for y in (" ".join(html.unescape(z).split()) for z in parts) if y)

    got = {r.page_id: r for r in html_extract.op10_html_extraction(spark, sf).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 2000), (4, "u", "<script>x<y</script><nav>menu</nav"), (4, "u", "&amp"), (None, "u", "<p>a < b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(df, html_extract.train(df)).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2, 3)} == {""}


def test_blocks_of_odd_tags():
    text = lambda page: [b[0] for b in html_extract.blocks(page)]
    assert text("<article><p class=it's>One text</p><p>don't</p><p>last</p>") == ["One text", "don't", "last"]
    assert text("<p title=Bob's>a</p><p title='x>y' class=\"c\">b</p>") == ["a", "b"]
    assert text("<svg><svg>in</svg>x</svg><p>out</p><svg/><p>more</p>") == ["out", "more"]
    assert text("<p>end</p><a href='never closed") == ["end"]


def test_long_and_broken_pages_take_linear_work():
    import time

    began = time.perf_counter()
    assert len(html_extract.blocks("<p>a b</p>" * 100_000)) == 100_000
    html_extract.blocks("<a href='x " * 40_000)
    html_extract.blocks('<p class="' * 40_000)
    assert time.perf_counter() - began < 20


def test_blocks():
    got = html_extract.blocks('<div class="ad big">x &lt; y<br>z</div><ul><li><a href=#>One</a><li>Two</ul><p>a<p>b<!-- c --><style>p{}</style>')
    assert [(t, p) for t, p, _ in got] == [("x < y z", ("div", "class=ad", "class=big")), ("One", ("ul", "li")), ("Two", ("ul", "li")), ("a", ("p",)), ("b", ("p",))]
    assert got[1][2] == 1.0


def test_shared_folder(spark):
    assert folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pipeline(spark, sf):
    """Stage by stage against plain Python on each stage's input."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        at = f"{folder(spark)}/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(at)
        before, docs = docs, spark.read.parquet(at)
        if name != "packing":
            assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert kept[name] <= ids
        if name == "near":
            groups = brute_near([(r.doc_id, r.text) for r in before.collect()])
            assert kept[name] == {i for i, c, _ in groups if i == c}
        if name == "packing":
            assert kept[name] == ids
            check_packing(docs.collect(), 2048)
    assert len(C.run(spark, sf).collect()) == docs.count()


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_bit_sliced_top_k", "op8_ngram_jaccard_join"])
def test_oracle(spark, sf, name):
    import duckdb

    from chronolake.llm import entry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    df = entry.queries()[name](spark, sf)
    assert df.columns == columns and Counter(map(tuple, df.collect())) == Counter(got.fetchall())
