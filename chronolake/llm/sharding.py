"""Sharding by sampled splitters.

Keys are (hash of the text, doc_id), so equal texts lie together. A sample drawn
with chances in proportion to size gives quantile splitters for many fine ranges;
ranges that come out overfull (a text that fills several shards) are divided
again by doc_id. Rows get their place in their range, ranges their place among
all, and the shard boundaries fall at equal shares of the bytes. A group of equal
texts that a boundary would cut goes to one side whole if it is small against a
shard; a larger one is cut where the bytes say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._work import stored

SHARDS, WHOLE = 8, 0.01  # groups up to this share of a shard stay whole
_LEAST = -(2**63)


def _ranges(cuts):
    ch, cd = cuts[:, 0].copy(), cuts[:, 1].copy()

    def f(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            doc = b.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(ch, h, "left"), np.searchsorted(ch, h, "right")
            split = np.flatnonzero(lo < hi)
            for k in np.unique(lo[split]):
                own = split[lo[split] == k]
                lo[own] = k + np.searchsorted(cd[k : hi[own[0]]], doc[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo.astype(np.int64))], [*b.schema.names, "rng"])

    return f


def _quantiles(sample, parts: int, by_doc: bool):
    """Splitters of a weighted sample of (h, doc_id, weight) into parts."""
    order = np.lexsort((sample[:, 1], sample[:, 0]))
    s = sample[order]
    w = np.cumsum(s[:, 2].astype(float))
    at = np.searchsorted(w, w[-1] * np.arange(1, parts) / parts)
    got = s[np.minimum(at, len(s) - 1)][:, :2].astype(np.int64)
    if not by_doc:
        got[:, 1] = _LEAST
    return got


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int = 32, rounds: int = 8):
    """(splitters as an array of (h, doc_id), [(range, bytes, rows)]) such that no range that can be divided exceeds twice its share."""
    spark_cols = ["h", F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), "size"]
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def sample(df, bytes_, want):
        p = F.least(F.lit(1.0), F.col("size") * want / max(1, bytes_))
        got = df.where(draw < p).select(*spark_cols, p.alias("p")).toArrow()  # about ``want`` rows
        cols = [got.column(c).to_numpy().astype(np.int64) for c in ("h", "doc_id")]
        weight = (got.column("size").to_numpy() / np.maximum(got.column("p").to_numpy(), 1e-12)).astype(np.int64)
        return np.stack([*cols, weight], axis=1).reshape(-1, 3)

    cuts = np.zeros((0, 2), np.int64)
    s = sample(rows, total, ranges * per_range)
    if ranges > 1 and len(s):
        cuts = np.unique(_quantiles(s, ranges, False), axis=0)
    for k in range(rounds + 1):
        ranged = rows.mapInArrow(_ranges(cuts), "doc_id long, size long, text_crc32 long, h long, rng long")
        stats = ranged.groupBy("rng").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # a row for each range
        over = {r.rng: r.b for r in stats if r.n > 1 and r.b > 2 * total / ranges}
        if not over or k == rounds:  # the last pass only measures, so that stats describe the cuts
            break
        more = []
        parts = ranged.where(F.col("rng").isin(list(over)))
        share = sum(over.values())
        s = sample(parts, share, max(64, int(per_range * ranges * share / total)) * 2)
        owner = _owner(cuts, s)
        for rng, b in over.items():
            own = s[owner == rng]
            if len(own) > 1:
                more.append(_quantiles(own, max(2, int(b * ranges / total) + 1), True))
        new = np.unique(np.concatenate([cuts, *more]), axis=0) if more else cuts
        if len(new) == len(cuts):
            break
        cuts = new
    return cuts, stats


def _owner(cuts, s):
    batch = pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1])], ["h", "doc_id"])
    return next(_ranges(cuts)([batch])).column("rng").to_numpy()


def shard(docs: DataFrame, shards: int = SHARDS, range_bytes: int = 64 << 20, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; shards have nearly equal bytes.

    A size is the text's bytes plus 1 (a null text has none; its checksum is that of
    no bytes). Null doc_ids sort first; rows alike in doc_id and text are
    interchangeable. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    cuts, stats = splitters(rows, total, max(256, -(-total // range_bytes)))
    before, at = [], 0
    for r in sorted(stats, key=lambda r: r.rng):
        before.append((r.rng, at))
        at += r.b
    ranged = rows.mapInArrow(_ranges(cuts), "doc_id long, size long, text_crc32 long, h long, rng long")
    # one short row for each range, whose number follows from range_bytes
    ranged = ranged.join(F.broadcast(spark.createDataFrame(before, "rng long, before long")), "rng")
    by_range = Window.partitionBy("rng").orderBy("h", "doc_id", "text_crc32")
    group = Window.partitionBy("rng", "h")
    share = max(1.0, total / shards)
    placed = (
        ranged.withColumn("end", F.col("before") + F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("g0", F.min(F.col("end") - F.col("size")).over(group))
        .withColumn("g1", F.max("end").over(group))
        .withColumn("mid", F.when(F.col("g1") - F.col("g0") <= whole * share, (F.col("g0") + F.col("g1")) / 2).otherwise(F.col("end") - F.col("size") / 2))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("mid") / share)).cast("int"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("rng", "shard").orderBy("h", "doc_id", "text_crc32")))
        .select("doc_id", "size", "text_crc32", "rng", "shard", "nth")
    )
    placed = stored(placed, "shard-places")
    counts = sorted((r.shard, r.rng, r.n) for r in placed.groupBy("shard", "rng").agg(F.count("*").alias("n")).collect())
    first, at, of = [], 0, None
    for s, rng, n in counts:
        at, of = (0 if s != of else at), s
        first.append((s, rng, at))
        at += n
    out = placed.join(F.broadcast(spark.createDataFrame(first, "shard int, rng long, first long")), ["shard", "rng"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
