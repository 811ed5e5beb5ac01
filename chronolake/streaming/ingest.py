"""Streaming ingest: policy, deduplication, admission, merging into tables.

Stateful operators keep a bounded state for each key and end it by timer, so state
does not grow with the stream. Batch forms of the same rules are in ``batch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import ship


def _times(pdfs: Iterator[pd.DataFrame], time: str):
    rows = pd.concat(list(pdfs), ignore_index=True)
    return rows.iloc[rows[time].argsort(kind="stable")].reset_index(drop=True)


def dedup(df: DataFrame, key: str, time: str, seconds: int, refresh: bool) -> DataFrame:
    """Drop a row whose key was seen within ``seconds``.

    refresh: each row seen renews the key's time (sliding); otherwise only rows that
    pass do, so a key that keeps coming passes once in ``seconds`` (tumbling from the
    first). State for a key is one time and ends when it can no longer matter.
    """
    ship(df.sparkSession)
    span = seconds * 1_000_000

    def f(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _times(pdfs, time)
        keep = []
        for at in rows[time]:
            new = last is None or at - last > span
            keep.append(new)
            if new or refresh:
                last = at if last is None else max(last, at)
        state.update((int(last),))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield rows[keep]

    return df.groupBy(key).applyInPandasWithState(f, df.schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def admit_novel(df: DataFrame, key: str, vector: str, time: str, ring: int = 16, base: float = 0.12, step: float = 0.02, cap: float = 0.45) -> DataFrame:
    """Rows whose novelty, 1 - max cosine with the last ``ring`` admitted of the session, reaches the threshold, which rises with each admission."""
    import numpy as np

    ship(df.sparkSession)
    fields = df.schema

    def f(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        flat, dim, n = state.get if state.exists else ([], 0, 0)
        kept = [np.array(flat[i : i + dim]) for i in range(0, len(flat), dim)] if dim else []
        rows = _times(pdfs, time)
        keep = []
        for v in rows[vector]:
            v = np.asarray(v, float)
            size = np.linalg.norm(v)
            near = max((float(v @ o / (size * np.linalg.norm(o))) for o in kept if len(o) == len(v) and size and o.any()), default=0.0)
            new = 1 - near >= min(cap, base + step * n)
            keep.append(new)
            if new:
                kept, n = [*kept, v][-ring:], n + 1
                if any(len(o) != len(v) for o in kept):
                    kept = [v]
        dim = len(kept[-1]) if kept else 0
        state.update(([float(x) for o in kept for x in o], dim, n))
        state.setTimeoutDuration(3_600_000)
        yield rows[keep]

    return df.groupBy(key).applyInPandasWithState(f, fields, "ring array<double>, dim int, admitted int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def switch_ring(df: DataFrame, key: str, value: str, time: str, size: int = 15, least_rows: int = 8, least_distinct: int = 6) -> DataFrame:
    """A row for each alert: the ring holds enough rows of enough different values; an alert empties it."""
    ship(df.sparkSession)

    def f(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        ring = list(state.get[0]) if state.exists else []
        out = []
        for at, v in _times(pdfs, time)[[time, value]].itertuples(index=False):
            ring = [*ring, str(v)][-size:]
            if len(ring) >= least_rows and len(set(ring)) >= least_distinct:
                out.append((k[0], at, len(set(ring))))
                ring = []
        state.update((ring,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(out, columns=[key, time, "distinct"])

    types = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(f, f"{key} {types[key]}, {time} {types[time]}, distinct long", "ring array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(df: DataFrame, time: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Event-time windows with a watermark (an extension: capture itself has processing order only)."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def flush(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, policy: Column | None = None, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Write micro-batches; the policy is applied again at the flush, in case it has changed since capture."""

    def write(batch: DataFrame, no: int) -> None:
        sink(batch if policy is None else batch.where(policy), no)

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if not once:
        return w.trigger(processingTime=every).start()
    # processing-time timeouts ask for empty batches for ever; a run over what is there needs none
    conf, name = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return w.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def share_chain(df: DataFrame, decision: Column, allowed: Column, text: str, scrubbed: Column) -> DataFrame:
    """classify, gate, scrub: rows with their outcome; text only where it is shared."""
    out = F.when(decision == "BLOCKED", "blocked").when(decision == "LOCAL_ONLY", "local").when(~allowed, "gated").otherwise("queued")
    return df.withColumn("outcome", out).withColumn(text, F.when(F.col("outcome") == "queued", scrubbed))


def watched_folder(spark, path: str, schema: str, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    """New files of a folder (not its subfolders) as a stream of JSON rows; temporary files are left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).json(path).where(~F.col("_metadata.file_name").rlike("\\.(tmp|part|crdownload)$|^\\."))
