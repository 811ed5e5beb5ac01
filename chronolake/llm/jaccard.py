"""Near-duplicate join on word 5-grams with Bayesian candidate pruning.

Texts of one word sequence (case and punctuation aside) are one class. Classes
get MinHash bands and a short sketch of 4-bit MinHash values; each worker sends
its distinct (band, class) pairs, packed by bucket of the band hash. Inside a
band's bucket, classes whose sketches leave the threshold a chance are linked,
as a spanning forest only, and the components of those links are the candidate
groups. A group brings its texts together once (a large one in pairs of chunks):
MinHash values are compared a few at a time, a pair is dropped once the posterior
probability of reaching the threshold is below the tolerance, and the rest is
verified exactly on the shingle sets. Groups return link counts and a spanning
forest of the verified links, never pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._bloom import build, thinned
from ._graph import components, forest
from ._work import stored

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SKETCH_LEAST = 16  # of 32 sketch values; at J = 0.8 fewer agree with probability 1e-6
STEP, HASHES, TOLERANCE = 16, 64, 1e-6
CHUNK, ALL_PAIRS = 512, 20_000

_R = np.random.default_rng(20240229)
_MUL = _R.integers(0, 2**31, max(BANDS * ROWS, HASHES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _R.integers(0, 2**32, max(BANDS * ROWS, HASHES), dtype=np.uint32)


def tokens(col):
    """(lower-cased word hashes, index of each text's first word)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return T.word_hashes(pc.utf8_lower(col), T.PUNCT)


def shingles(h, first, words: int = WORDS):
    """(shingle hashes, index of each text's first shingle); a text of fewer words is one shingle, one of none has none."""
    n = np.diff(first)
    w, fits = T.windows(h, first, words)
    short = np.flatnonzero((n > 0) & (n < words))
    for i in short:
        a = first[i]
        w[a] = T.mix(np.array([np.bitwise_xor.reduce(T.mix(h[a : first[i + 1]] + np.arange(n[i]).astype(np.uint64)))], np.uint64))[0]
        fits[a] = True
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    return w[fits], np.concatenate([[0], np.cumsum(count)])


def minhashes(s, first, k: int):
    """(texts, k) MinHash values; texts without shingles get the maximum."""
    n = len(first) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.diff(first) > 0
    if full.any():
        x = (s >> np.uint64(32)).astype(np.uint32)
        at = first[:-1][full]
        for i in range(k):
            out[full, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], at)
    return out


def _classes(batches):
    """doc_id, text key, class of every row. A class is the word sequence; texts without words go by their bytes."""
    for b in batches:
        text = b.column("text")
        h, first = tokens(text)
        n = np.diff(first)
        key = np.zeros(len(n), np.uint64)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        if len(h):
            key[n > 0] = np.add.reduceat(T.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first[:-1][n > 0])
        for i in np.flatnonzero(n == 0):
            raw = (text[i].as_py() or "").encode()
            key[i] = T.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0] if raw else 1
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(T.mix(key + n.astype(np.uint64)).view(np.int64), mask=text.is_null().to_numpy(zero_copy_only=False)), pa.array(n.astype(np.int64))], ["doc_id", "h", "class", "n"])


_PAIR = np.dtype([("band", "<u8"), ("class", "<i8"), ("lo", "<u8"), ("hi", "<u8")])


def _sketch(m):
    """Two 64-bit words of 4-bit values, one from each band's first MinHash."""
    v = (T.mix(m[:, ::ROWS].astype(np.uint64)) >> np.uint64(60)).astype(np.uint64)
    out = np.zeros((len(m), 2), np.uint64)
    for k in range(BANDS):
        out[:, k // 16] |= v[:, k] << np.uint64(4 * (k % 16))
    return out


def _bands(buckets):
    def f(batches):
        for b in batches:
            text = b.column("text")
            data_h, data_f = tokens(text)
            _, off = T.buffers(text)
            for i, j in T.chunks(off, 1 << 19):
                h, first = data_h[data_f[i] : data_f[j]], data_f[i : j + 1] - data_f[i]
                s, f0 = shingles(h, first)
                has = np.flatnonzero(np.diff(f0) > 0)
                if not len(has):
                    continue
                cls = b.column("class").to_numpy()[i:j][has]
                m = minhashes(s, f0, BANDS * ROWS)[has]
                sk = _sketch(m)
                rows = np.zeros((len(has), BANDS), _PAIR)
                rows["class"], rows["lo"], rows["hi"] = cls[:, None], sk[:, :1], sk[:, 1:]
                for k in range(BANDS):
                    x = np.full(len(has), k + 1, np.uint64)
                    for r in range(ROWS):
                        x = T.mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, k * ROWS + r].astype(np.uint64))
                    rows["band"][:, k] = x
                rows = np.unique(rows.reshape(-1))
                part = (rows["band"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(buckets + 1))
                own = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([rows[order[cut[p] : cut[p + 1]]].tobytes() for p in own], pa.binary())], ["bucket", "pairs"])

    return f


def _agree(lo, hi, lo2, hi2):
    """How many of the 32 sketch values agree."""
    total = np.zeros(np.broadcast(lo, lo2).shape, np.uint8)
    for a, b in ((lo, lo2), (hi, hi2)):
        x = a ^ b
        x = x | x >> np.uint64(2)
        x = (x | x >> np.uint64(1)) & np.uint64(0x1111111111111111)
        total += (16 - np.bitwise_count(x)).astype(np.uint8)
    return total


def _link(table: pa.Table) -> pa.Table:
    rows = np.concatenate([np.frombuffer(x, _PAIR) for x in table.column("pairs").to_pylist()])
    rows = np.unique(rows)  # by band, then class
    classes, node = np.unique(rows["class"], return_inverse=True)
    new = np.ones(len(rows), bool)
    new[1:] = rows["band"][1:] != rows["band"][:-1]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    head = start[group]
    near = _agree(rows["lo"], rows["hi"], rows["lo"][head], rows["hi"][head]) >= SKETCH_LEAST
    at = np.flatnonzero(~new & near)
    a, b = [node[at]], [node[head[at]]]
    size = np.diff(np.append(start, len(rows)))
    far = np.zeros(len(start), bool)
    far[group[~new & ~near]] = True
    for g in np.flatnonzero(far & (size > 2)):
        s = slice(start[g], start[g] + size[g])
        lo, hi, own = rows["lo"][s], rows["hi"][s], node[s]
        if size[g] > ALL_PAIRS:  # too many to compare here: all stay candidates
            a.append(own[1:])
            b.append(np.full(size[g] - 1, own[0]))
            continue
        todo = np.flatnonzero(~near[s] | (np.arange(size[g]) == 0))[1:]
        for i in todo:  # those unlike the first, against all
            hit = np.flatnonzero(_agree(lo, hi, lo[i], hi[i]) >= SKETCH_LEAST)
            hit = hit[hit != i]
            a.append(own[hit])
            b.append(np.full(len(hit), own[i]))
    a, b = np.concatenate(a), np.concatenate(b)
    label = forest(len(classes), a, b)
    keep = np.flatnonzero(label != np.arange(len(classes)))
    return pa.table({"a": pa.array(classes[keep]), "b": pa.array(classes[label[keep]])})


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches that keep a pair: P(J >= threshold | matches) under a uniform prior."""
    x = np.linspace(0, 1, 20_001)[1:-1]
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for k in range(n + 1):
            log = k * np.log(x) + (n - k) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() >= tolerance * p.sum():
                break
        out.append(k)
    return tuple(out)


def _verify(threshold, tolerance):
    least = least_matches(threshold, tolerance)

    def pairs(sig, sets, size, rows, others):
        """Verified partners of each of ``rows`` among ``others`` (of a higher index, if they are the same)."""
        for i in rows:
            js = others[others > i] if others is rows else others
            s = size[i]
            js = js[(size[js] >= threshold * s - 1e-9) & (size[js] * threshold <= s + 1e-9)]
            hits = np.zeros(len(js), np.int64)
            for step, k in enumerate(least):
                cols = slice(step * STEP, (step + 1) * STEP)
                hits += (sig[js, cols] == sig[i, cols]).sum(axis=1)
                keep = hits >= k
                js, hits = js[keep], hits[keep]
                if not len(js):
                    break
            if len(js):
                flat = np.concatenate([sets[j] for j in js])
                n = size[js]
                at = np.searchsorted(sets[i], flat)
                both = np.add.reduceat(sets[i][np.minimum(at, s - 1)] == flat, np.cumsum(n) - n, dtype=np.int64)
                js = js[both >= threshold * (s + n - both) - 1e-9]
            yield i, js

    def f(table: pa.Table) -> pa.Table:
        comp, cls, copies = (table.column(c).to_numpy() for c in ("comp", "class", "copies"))
        side = table.column("side").to_numpy()
        cross = bool(table.column("cross")[0].as_py())
        h, first = tokens(table.column("text"))
        s, f0 = shingles(h, first)
        sig = minhashes(s, f0, HASHES)
        sets = [np.unique(s[f0[i] : f0[i + 1]]) for i in range(len(comp))]
        size = np.array([len(x) for x in sets], np.int64)
        links, a, b = np.zeros(len(comp), np.int64), [], []
        order = np.argsort(comp, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            own = np.sort(own[size[own] > 0])
            rows, others = (own[side[own] == 0], own[side[own] == 1]) if cross else (own, own)
            for i, js in pairs(sig, sets, size, rows, others if cross else rows):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                a.append(np.full(len(js), i))
                b.append(js)
        label = forest(len(comp), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(comp))
        keep = np.flatnonzero(links > 0)
        return pa.table({"class": pa.array(cls[keep]), "links": pa.array(links[keep]), "to": pa.array(cls[label[keep]])})

    return f


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, n_links of every row.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``; class_id is the smallest doc_id of all that
    links connect, n_links the number of other rows linked with this one, copies
    included. Words are runs of letters and digits in lower case. A text of one to
    four words is one shingle; texts without a word are linked if equal; a null text
    is linked with nothing. Rows of one doc_id are rows of their own. Extra columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = stored(docs.mapInArrow(_classes, "doc_id long, h long, class long, n long"), "classes")
    sets = stored(rows.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("one")), "sets")
    # texts with their class again, one row for each class of a batch
    with_class = docs.where("text is not null").mapInArrow(_with_class, "text string, class long")
    buckets = max(16, min(4096, rows.count() // 4096))
    edges = with_class.mapInArrow(_bands(buckets), "bucket long, pairs binary").groupBy("bucket").applyInArrow(_link, "a long, b long")
    groups = components(edges).withColumnsRenamed({"node": "class", "label": "comp"})
    sizes = groups.groupBy("comp").agg(F.count("*").alias("m"))
    members = stored(groups.join(sizes, "comp").join(sets, "class").select("class", "comp", "m", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.h").alias("h")), "members")
    n = members.count()
    own = thinned(docs, "h", build(members, n))  # else every text is shuffled for the few that have a partner
    texts = members.join(own, members.doc_id.eqNullSafe(own.doc_id) & (members.h == own.h)).select("class", "comp", "m", "copies", "text")
    texts = texts.groupBy("class").agg(F.first("comp").alias("comp"), F.first("m").alias("m"), F.first("copies").alias("copies"), F.first("text").alias("text"))
    chunks = F.ceil(F.col("m") / chunk)
    small = F.col("m") <= chunk
    spread = (
        texts.withColumn("own", F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("class"), chunks)).cast("long"))
        .withColumn("other", F.explode(F.when(small, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long")))))
        .select(
            F.when(small, F.pmod(F.xxhash64("comp"), F.lit(max(64, n // 256)))).otherwise(F.col("comp")).alias("g"),
            F.least("own", "other").alias("p"),
            F.greatest("own", "other").alias("q"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            (F.col("own") != F.col("other")).alias("apart"),
            "comp",
            "class",
            "copies",
            "text",
        )
        .withColumn("cross", F.col("p") != F.col("q"))
    )
    found = stored(spread.select("g", "p", "q", "side", "cross", "comp", "class", "copies", "text").groupBy("g", "p", "q").applyInArrow(_verify(threshold, tolerance), "class long, links long, to long"), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("class").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"node": "class"})
    known = sets.join(links, "class", "left").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    known = known.select("class", "label", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = known.groupBy("label").agg(F.min("least").alias("class_id"))
    per_class = known.join(ids, "label").select("class", "class_id", "n_links")
    out = rows.join(per_class, "class", "left")
    return out.select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_class(batches):
    for b in batches:
        ids = next(_classes([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("h"), b.column("text")], ["doc_id", "h", "text"])])).column("class")
        _, one = np.unique(ids.to_numpy(), return_index=True)
        one = pa.array(np.sort(one))
        yield pa.RecordBatch.from_arrays([b.column("text").take(one), ids.take(one)], ["text", "class"])


def op8_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: For tables whose doc_ids are unique.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') WHEN len(w) > 0 THEN array_to_string(w, ' ') || '#' ELSE 'raw:' || text END AS g
  FROM (SELECT doc_id, text, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
g AS (SELECT id, min(c) AS c FROM r GROUP BY id), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(k, 0) AS n_links FROM documents LEFT JOIN g ON id = doc_id LEFT JOIN k ON a = doc_id
"""
