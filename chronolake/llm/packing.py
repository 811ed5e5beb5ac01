"""Bulk-synchronous best-fit packing of token pieces into sequences.

Lengths are whole numbers of at most the sequence length, so documents and gaps
sort into at most that many runs of equal ones, and a sweep over the sorted runs
stands for the sweep over the sorted documents. Rounds go from the longest
length down: a round's documents are matched with the smallest gap that holds
them (the successor), conflicts for a run of gaps are settled by rank, the gaps
shrink, and the round repeats until its documents are placed, opening sequences
only where no gap fits. The plan's size depends on the sequence length alone.
Spark measures the pieces, ranks them inside their length (each length dealt
over ``SALTS`` parts, so that a common length is no hot key) and looks the ranks
up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._tokens import encoder
from ._work import stored

CAPACITY, SALTS = 2048, 128
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _measure(path, capacity):
    def f(batches):
        e = encoder(path)
        for b in batches:
            data, off = T.buffers(b.column("text"))
            ids_col = b.column("doc_id")
            owner, piece, start, length, crc = [], [], [], [], []
            for i, j in T.chunks(off):
                ids, first = e.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, first[1:], 0).astype("<u4")
                first = first + np.arange(len(first))
                raw = memoryview(ids.tobytes())
                for k in range(j - i):
                    a, z = int(first[k]), int(first[k + 1])
                    for n, at in enumerate(range(a, z, capacity)):
                        to = min(z, at + capacity)
                        owner.append(i + k)
                        piece.append(n)
                        start.append(at - a)
                        length.append(to - at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * to]))
            yield pa.RecordBatch.from_arrays(
                [ids_col.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return f


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(rows of (length, first rank, end rank, first sequence, offset), number of sequences) for counts[length] pieces."""
    rows, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    sizes: list[int] = []

    def shrink(gap, first, n):
        if gap and n:
            if not gaps.get(gap):
                insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in range(capacity, 0, -1):
        rank, left = 0, int(counts[length]) if length < len(counts) else 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                first, gap = opened, capacity
                opened += n
                took = min(left, n)
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                took = min(left, n)
                if took < n:
                    gaps[gap].append((first + took, n - took))
                elif not gaps[gap]:
                    sizes.pop(at)
            rows.append((length, rank, rank + took, first, capacity - gap))
            shrink(gap - length, first, took)
            rank, left = rank + took, left - took
    return np.array(rows, np.int64).reshape(-1, 5), opened


def _assign(rows, offsets):
    """offsets: for each (length, salt) the rank of its first piece."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    key = rows[:, 0] << 48 | rows[:, 1]

    def f(batches):
        for b in batches:
            length, salt, nth = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "nth"))
            rank = offsets[length * SALTS + salt] + nth - 1
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            r = rows[at]
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start")}
            cols |= {"length": pa.array(length), "ids_crc32": b.column("ids_crc32"), "sequence_id": pa.array(r[:, 3] + rank - r[:, 1]), "offset": pa.array(r[:, 4])}
            yield pa.RecordBatch.from_pydict(cols)

    return f


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids and a final 0; longer ones are cut every ``capacity``
    ids. A null text is empty (one piece, the 0). Rows are packed one by one:
    repeated rows and null doc_ids are documents of their own. Extra columns are
    ignored; an empty table gives an empty result.
    """
    if not 0 < capacity < 1 << 15:
        raise ValueError("capacity must be between 1 and 32767")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(docs.mapInArrow(_measure(vocabulary, capacity), _PIECES), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    pieces = pieces.withColumn("salt", salt)
    found = pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).toArrow()  # at most capacity x SALTS rows
    count = np.zeros((capacity + 1) * SALTS, np.int64)
    count[found.column("length").to_numpy().astype(np.int64) * SALTS + found.column("salt").to_numpy()] = found.column("n").to_numpy()
    by_length = count.reshape(-1, SALTS)
    offsets = (np.cumsum(by_length, axis=1) - by_length).reshape(-1)
    rows, _ = plan(by_length.sum(axis=1), capacity)
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    return ranked.mapInArrow(_assign(rows, offsets), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
