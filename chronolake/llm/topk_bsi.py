"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to whole numbers. A block of rows, in vec_id order, is
indexed as bit slices: for each attribute, one bitmap for each binary digit of
its offset value. A query adds the slices, weighted by its own components, with
carry-save bitmap arithmetic; the digits of all scores of the block come out as
bitmaps. The k highest are picked from the most significant slice downward; rows
that tie at the boundary are taken in vec_id order. Blocks report k rows for each
query and Spark ranks those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._work import stored

SCALE, TOP, EVERY = 64, 20, 20
BLOCK_ROWS, CHUNK_QUERIES = 16384, 256

_INDEX = "blk long, dim int, ids binary, low binary, width binary, slices binary"
_CHUNK = "chunk long, dim int, ids binary, q binary"


def quantise(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers; beyond ``limit`` of the dimension, where a score need not fit a long, they saturate."""
    most = limit(vectors.shape[1])
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -most, most).astype(np.int64)


def limit(dim: int) -> int:
    """The largest component for which sums over slices of all ``dim`` attributes fit 63 bits."""
    return math.isqrt((1 << 60) // max(1, dim))


def _matrix(table: pa.Table):
    """(ids ascending, quantised vectors) of rows of one dimension."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    v = quantise(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
    order = np.lexsort((*v.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    return ids[order], v[order]


def bitmaps(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, words) of one attribute's values, 64 rows a word."""
    words = -(-len(values) // 64)
    out = np.zeros((bits, words * 8), np.uint8)
    for k in range(bits):
        packed = np.packbits((values >> k & 1).astype(np.uint8), bitorder="little")
        out[k, : len(packed)] = packed
    return out.view(np.uint64)


def _index(table: pa.Table) -> pa.Table:
    blk, dim = table.column("blk")[0].as_py(), table.column("dim")[0].as_py()
    ids, v = _matrix(table)
    low = v.min(axis=0)
    width = np.array([int(x).bit_length() for x in (v - low).max(axis=0)], np.int64)
    slices = b"".join(bitmaps(v[:, d] - low[d], int(width[d])).tobytes() for d in range(dim))
    return pa.table([[blk], [dim], [ids.astype("<i8").tobytes()], [low.tobytes()], [width.tobytes()], [slices]], ["blk", "dim", "ids", "low", "width", "slices"]).cast(pa.schema([("blk", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.binary()), ("slices", pa.binary())]))


def _chunk(table: pa.Table) -> pa.Table:
    chunk, dim = table.column("chunk")[0].as_py(), table.column("dim")[0].as_py()
    ids, v = _matrix(table)
    return pa.table([[chunk], [dim], [ids.astype("<i8").tobytes()], [v.tobytes()]], ["chunk", "dim", "ids", "q"]).cast(pa.schema([("chunk", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("q", pa.binary())]))


class Block:
    """The slices of one block of rows and the sums of a query over them."""

    def __init__(self, ids, low, width, raw, dim):
        self.ids = ids
        self.low, self.width = low, width
        words = -(-len(ids) // 64)
        flat = np.frombuffer(raw, np.uint64).reshape(-1, words)
        at = np.cumsum(width) - width
        self.up = [flat[at[d] : at[d] + width[d]] for d in range(dim)]
        self.rows = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.rows[: len(packed)] = packed
        self.rows = self.rows.view(np.uint64)
        self.words = words

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """(digits, words) of the scores less a constant, and that constant."""
        span = (np.int64(1) << self.width) - 1
        most = int(np.abs(q) @ span)
        digits = max(1, most.bit_length())
        s = np.zeros((digits + 1, self.words), np.uint64)
        c = np.zeros((digits + 1, self.words), np.uint64)
        base = int(q @ self.low)
        for d, x in enumerate(self.up):
            w = int(q[d])
            if w < 0:  # w * u = -w * (span - u) + w * span
                base += w * int(span[d])
                x = ~x
                w = -w
            k, n = 0, len(x)
            while w and n:
                if w & 1:
                    # carry-save: s + c + (x << k), over the digits from k up
                    a, b = s[k : k + n], c[k : k + n]
                    t = a ^ b
                    carry = (a & b) | (t & x)
                    s[k : k + n] = t ^ x
                    rest = slice(k + n, digits)
                    a, b = s[rest], c[rest]
                    high = a & b
                    s[rest] = a ^ b
                    c[k] = 0
                    c[k + 1 : k + n + 1] = carry
                    c[k + n + 1 : digits + 1] = high
                w >>= 1
                k += 1
        carry = np.zeros(self.words, np.uint64)
        for k in range(digits):
            t = s[k] ^ c[k]
            s[k], carry = t ^ carry, (s[k] & c[k]) | (t & carry)
        return s[:digits], base

    def top(self, digits: np.ndarray, want: int, own: int) -> np.ndarray:
        """Rows of the ``want`` highest scores, the first in vec_id order where they tie; rows of id ``own`` take no part."""
        sure = np.zeros(self.words, np.uint64)
        even = self.rows.copy()
        a, z = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for r in range(a, z):
            even[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        have = 0
        for x in digits[::-1]:
            one = even & x
            n = int(np.bitwise_count(one).sum())
            if have + n > want:
                even = one
            else:
                sure |= one
                have += n
                even &= ~x
                if have == want:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if have < want:
            tied = np.flatnonzero(np.unpackbits(even.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, tied[: want - have]])
        return rows


def _search(want):
    def f(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                block = Block(ids, np.frombuffer(r["low"], np.int64), np.frombuffer(r["width"], np.int64), r["slices"], r["dim"])
                qids = np.frombuffer(r["qids"], "<i8")
                out = []
                for i, (own, q) in enumerate(zip(qids.tolist(), np.frombuffer(r["q"], np.int64).reshape(len(qids), -1))):
                    digits, base = block.scores(q)
                    rows = block.top(digits, want, own)
                    score = np.full(len(rows), base, np.int64)
                    for k in range(len(digits)):
                        score += (digits[k][rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
                    out.append((np.full(len(rows), i), np.full(len(rows), own), ids[rows], score))
                i, own, row, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["chunk"])), pa.array(i), pa.array(own), pa.array(row), pa.array(score)], ["chunk", "place", "query_id", "vec_id", "score"])

    return f


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k highest inner products among ``rows``.

    Both tables have vec_id and embedding. A vector that is null, empty, or holds a
    null or a non-finite component takes no part, nor does a row without vec_id;
    only vectors of one length meet. Rows of the query's own vec_id are its own.
    Repeated rows are candidates each; a query row that occurs twice is answered
    twice. Scores are exact for quantised components up to ``limit(dim)``, 134,217,728
    at 64 attributes; beyond, where a score need not fit a long, components saturate.
    Fewer than k candidates: all.
    """
    spark = rows.sparkSession
    ship(spark)

    def valid(df):
        v = F.col("embedding").cast("array<double>")
        ok = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(ok).withColumn("dim", F.size("v")).where("dim > 0")

    rows, queries = valid(rows), valid(queries)
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, -(-queries.count() // chunk_queries))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("long")
    index = stored(rows.withColumn("blk", deal(blocks)).groupBy("blk", "dim").applyInArrow(_index, _INDEX), "bit-slices")
    chunked = queries.withColumn("chunk", deal(chunks)).groupBy("chunk", "dim").applyInArrow(_chunk, _CHUNK).withColumnRenamed("ids", "qids")
    # every block meets every chunk of the stated queries: blocks x chunks rows
    met = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).repartition(max(1, min(blocks * chunks, 4096)), "blk", "chunk").join(chunked.hint("shuffle_hash"), ["chunk", "dim"])
    found = met.mapInArrow(_search(k), "chunk long, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "chunk", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_bit_sliced_top_k(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
