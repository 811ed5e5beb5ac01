"""Exact substring deduplication over fixed-length word windows.

Documents are cut into blocks of consecutive doc_ids. Each block sends, for each
bucket of the hash space, its sorted distinct Rabin-Karp window hashes as one
binary row. A bucket sees every block's list and answers each block with one bit
per hash: seen in an earlier block or not. Blocks then look the bits up, settle
repeats inside themselves by doc_id, merge covered words into maximal intervals
and cut them out. A window that millions of documents share costs one hash per
block and its answer one bit, so no key is hot; texts are shuffled once.

A window is named by 64 bits plus its bucket, which comes from a second,
independent hash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._work import RANGED, into_ranges, range_cuts

WIDTH = 13
_BASE2 = 0xD1342543DE82EF95


def _hashes(table, width, buckets):
    """First words of the texts, and place, hash and bucket of every window of a row that has a doc_id."""
    h, first = T.word_hashes(table.column("text"), T.SPACES)
    w, fits = T.windows(h, first, width)
    b, _ = T.windows(h, first, width, _BASE2)
    null = table.column("doc_id").is_null().to_numpy()
    fits &= ~np.repeat(null, np.diff(first))
    at = np.flatnonzero(fits)
    return first, at, w[at], (b[at] % np.uint64(buckets)).astype(np.int64)


def _distinct(w, b):
    """Order by (bucket, hash), and which of that order begins a distinct pair."""
    order = np.lexsort((w, b))
    ws, bs = w[order], b[order]
    new = np.ones(len(ws), bool)
    new[1:] = (ws[1:] != ws[:-1]) | (bs[1:] != bs[:-1])
    return order, ws, bs, new


def _send(width, buckets):
    def f(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, _, w, b = _hashes(table, width, buckets)
        _, ws, bs, new = _distinct(w, b)
        ws, bs = ws[new], bs[new]
        cut = np.searchsorted(bs, np.arange(buckets + 1))
        have = np.flatnonzero(np.diff(cut))
        return pa.table({"bucket": pa.array(have, pa.int64()), "block": pa.array(np.full(len(have), block), pa.int64()), "hashes": pa.array([ws[cut[k] : cut[k + 1]].tobytes() for k in have], pa.binary())})

    return f


def _answer(table: pa.Table) -> pa.Table:
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    parts = [parts[i] for i in order]
    h = np.concatenate(parts)
    by = np.argsort(h, kind="stable")  # equal hashes stay in ascending block order
    hs = h[by]
    later = np.zeros(len(h), bool)
    later[by[1:]] = hs[1:] == hs[:-1]
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(x).tobytes() for x in np.split(later, ends[:-1])]
    return pa.table({"block": pa.array(block[order], pa.int64()), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _cut(width, buckets):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").combine_chunks()
        doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, at, w, b = _hashes(docs, width, buckets)
        owner = np.repeat(np.arange(len(doc)), np.diff(first))
        hit = np.zeros(len(at), bool)
        if len(at) and answers.num_rows:
            order, ws, bs, new = _distinct(w, b)
            group = np.cumsum(new) - 1
            count = np.bincount(bs[new], minlength=buckets)
            start = np.cumsum(count) - count
            seen = np.zeros(int(new.sum()), bool)
            for k, raw in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
                seen[start[k] : start[k] + count[k]] = np.unpackbits(np.frombuffer(raw, np.uint8))[: count[k]]
            d = doc[owner[at[order]]]
            least = np.minimum.reduceat(d, np.flatnonzero(new))
            hit[order] = seen[group] | (least[group] < d)
        edge = np.zeros(len(owner) + 1, np.int32)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n = np.diff(first)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        kept, runs = [], []
        for i, text in enumerate(docs.column("text").to_pylist()):
            words = (text or "").encode().split()
            spans = []
            if removed[i]:
                g = gone[first[i] : first[i + 1]]
                e = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans = [{"first": int(x), "last": int(y) - 1} for x, y in e.reshape(-1, 2)]
                words = list(compress(words, ~g))
            kept.append(b" ".join(words).decode())
            runs.append(spans)
        return pa.table([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return f


def substring_dedup(docs: DataFrame, width: int = WIDTH, block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed word intervals of every row.

    A word goes if a window of ``width`` words over it also starts in a document
    with a smaller doc_id; windows are those of the input. Null text: no words.
    Null doc_id: the row neither removes nor loses anything. Rows with one doc_id
    (repeats included) do not remove each other's words; each gives its own row.
    Extra columns are ignored. An empty table gives an empty result.
    ``block_bytes`` bounds what one task holds; blocks and buckets grow with the input.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts, size = range_cuts(docs, block_bytes)
    buckets = min(1 << 16, max(32, -(-size // bucket_bytes)))
    cut = docs.mapInArrow(into_ranges(cuts), RANGED).withColumnRenamed("rng", "block")
    sent = cut.groupBy("block").applyInArrow(_send(width, buckets), "bucket long, block long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, bits binary")
    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _cut(width, buckets), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:int,last:int>>"
    )


def op1_substring_dedup(spark, sf_dir) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: For tables whose doc_ids are unique.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (g) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM w ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
