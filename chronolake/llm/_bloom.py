"""Bloom filters of a fixed size, to thin rows out before a join.

A filter has at most MOST_BITS bits whatever it holds, so it may go to every task;
overfull, it lets more rows through to the join that follows, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26


def places(h: np.ndarray, bits: int):
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(34)) & mask).astype(np.int64)


def _part(bits):
    def f(table: pa.Table) -> pa.Table:
        on = np.zeros(bits, bool)
        for at in places(table.column("h").to_numpy().view(np.uint64), bits):
            on[at] = True
        return pa.table({"bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    return f


def build(keys: DataFrame, n: int) -> np.ndarray:
    """The packed filter of the column h (long, well mixed) of about n rows; eight partial filters reach the driver."""
    bits = min(MOST_BITS, 1 << max(16, int(16 * max(1, n)).bit_length()))
    parts = keys.select("h", F.pmod(F.xxhash64("h"), F.lit(8)).alias("part")).groupBy("part").applyInArrow(_part(bits), "bits binary").collect()
    packed = np.zeros(bits // 8, np.uint8)
    for r in parts:
        packed |= np.frombuffer(r.bits, np.uint8)
    return packed


def may_hold(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for at in places(h, len(packed) * 8):
        hit &= (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def thinned(df: DataFrame, column: str, packed: np.ndarray) -> DataFrame:
    """Rows of df whose ``column`` (long) may be in the filter."""
    at = df.columns.index(column)

    def f(batches):
        for b in batches:
            yield b.filter(pa.array(may_hold(packed, b.column(at).to_numpy(zero_copy_only=False).view(np.uint64))))

    return df.mapInArrow(f, df.schema)
