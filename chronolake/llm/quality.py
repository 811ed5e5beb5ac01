"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal updates.

A text's n-grams are its words, pairs of neighbouring words, and runs of one to
three word shapes (kinds of the first and last characters, case, repetition of
the word before), each hashed to a weight. A score is the sparse dot product
of the counts, divided by the number of words, with the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from . import _tokens

BITS, TRAIN_ROWS, EPOCHS, THRESHOLD = 18, 6000, 4, 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
CHUNK = 1 << 18  # bytes of text that are scored at once; they take about 35 times as much (9 MB measured)
_GAIN = 4.0  # features are shares of the words; this keeps steps of a useful size

_KIND = np.full(256, 4, np.uint8)  # 0 digit, 1 upper, 2 lower, 3 beyond ASCII, else 4 and the character itself
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 0, 1, 2, 3
_SIGN = np.where(_KIND == 4, np.arange(256) + 8, _KIND).astype(np.uint64)


def features(data: np.ndarray, off: np.ndarray):
    """(hashed features, one row for each n-gram kind and a column for each word; index of each text's first word)."""
    s, e, first = T.spans(data, off, T.SPACES)
    if len(s) == 0:
        return np.zeros((5, 0), np.int64), first
    h = T.span_hashes(data, s, e)
    head = np.zeros(len(s), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    prior = np.roll(h, 1)
    prior[head] = 0
    lower = np.bitwise_or.reduceat(_KIND[data] == 2, s)
    shape = _SIGN[data[s]] | _SIGN[data[e - 1]] << np.uint64(9) | _SIGN[data[np.maximum(e - 2, s)]] << np.uint64(18)
    shape |= lower.astype(np.uint64) << np.uint64(27) | (h == prior).astype(np.uint64) << np.uint64(28) | np.minimum(e - s, 7).astype(np.uint64) << np.uint64(29)
    one = np.roll(shape, 1)
    one[head] = 1
    two = np.roll(one, 1)
    two[head] = 1
    kinds = (h, T.mix(prior) + h, T.mix(shape + np.uint64(1)), T.mix(shape * np.uint64(31) + one) + np.uint64(2), T.mix(T.mix(shape * np.uint64(31) + one) + two) + np.uint64(3))
    return np.stack([(T.mix(x + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64) for i, x in enumerate(kinds)]), first


def fit(col, label: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, from texts and 0/1 labels; rows are taken in the order given."""
    data, off = T.buffers(col)
    n = 1 << BITS
    xs = []
    for i in range(len(off) - 1):
        f, _ = features(data[off[i] : off[i + 1]], off[i : i + 2] - off[i])
        idx, count = np.unique(f, return_counts=True)
        xs.append((idx.astype(np.int32), count.astype(np.int32), max(1, f.shape[1])))
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(xs)):
            idx, x = np.append(xs[i][0], n), np.append(_GAIN * xs[i][1] / xs[i][2], 1.0)
            zi, ni = z[idx], g2[idx]
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label[i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] += g - sigma * w
            g2[idx] += g * g
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2), 0.0)


def score(weights: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    f, first = features(data, off)
    n = np.diff(first)
    total = np.zeros(len(n))
    if f.shape[1]:
        per_word = weights[f[0]]
        for k in range(1, len(f)):
            per_word = per_word + weights[f[k]]
        full = n > 0
        total[full] = np.add.reduceat(per_word, first[:-1][full]) * _GAIN / n[full]
    return 1 / (1 + np.exp(-np.clip(total + weights[-1], -35, 35)))


def _fit(table: pa.Table) -> pa.Table:
    _tokens.forget()
    table = table.take(pa.compute.sort_indices(table, [("turn", "ascending"), ("doc_id", "ascending")]))
    w = fit(table.column("text"), table.column("quality").to_numpy().astype(float))
    return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled rows that are not held out, from at most ``rows`` of them (lowest hash of the id first).

    A doc_id with several labels counts as 1 if their mean is at least one half; null
    ids and labels are left out. Without a labelled row every weight is 0.
    """
    ship(docs.sparkSession)

    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .withColumn("turn", F.xxhash64("doc_id"))
        .orderBy("turn", "doc_id")
        .limit(rows)
    )
    # at most ``rows`` short rows: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    got = texts.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit, "weights binary").collect()
    return np.frombuffer(got[0].weights, float) if got else np.zeros((1 << BITS) + 1)


def _score(weights):
    w = weights.astype(np.float32)

    def f(batches):
        _tokens.forget()
        for b in batches:
            data, off = T.buffers(b.column("text"))
            s = [score(w, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in T.chunks(off, CHUNK)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    return f


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text scores as an empty one, by the intercept."""
    ship(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(weights), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least ``threshold``."""
    ship(docs.sparkSession)
    w = weights.astype(np.float32)
    at = docs.columns.index("text")

    def f(batches):
        _tokens.forget()
        for b in batches:
            data, off = T.buffers(b.column(at))
            s = [score(w, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in T.chunks(off, CHUNK)]
            yield b.filter(pa.array(np.concatenate(s) >= threshold if s else np.zeros(0, bool)))

    return docs.mapInArrow(f, docs.schema)


def op2_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
