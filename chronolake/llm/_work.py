"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset (tests, one machine) a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + os.path.join(tempfile.gettempdir(), "chronolake-checkpoints")
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing lazy reads it any more."""
    at = getattr(df, "_stored_at", None)
    if at:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(docs: DataFrame, target_bytes: int, most: int = 1 << 20):
    """(splitters of doc_id into ranges of about target_bytes of text, total bytes of text).

    Two aggregates; only the splitters reach the driver, at most ``most`` of them.
    """
    import numpy as np
    from pyspark.sql import functions as F

    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = min(most, max(1, -(-size // target_bytes)))
    got = []
    if n > 1:
        got = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"]
    return np.unique(np.array(got or [], np.int64)), size


def into_ranges(cuts):
    """A mapInArrow function from (doc_id, text) to (rng, doc_id, text); a null doc_id goes to range 0."""
    import numpy as np
    import pyarrow as pa

    def f(batches):
        for b in batches:
            ids = b.column("doc_id")
            k = np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), ids, b.column("text")], ["rng", "doc_id", "text"])

    return f


RANGED = "rng long, doc_id long, text string"
