"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import dropped, stored


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) of every node of edges (a, b): the label is the least node of its component.

    Each round is a minimum for each node and a join back; a node with very many
    neighbours is a partial aggregate and a skewed join, which Spark splits. Rounds
    are written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    check = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_min, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_min.select("a", F.col("m").alias("b"))).distinct()
        new = stored(small, "edges")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        dropped(e)
        e = new
        if check == (now.n, now.s):
            break
        check = (now.n, now.s)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes (the least node it reaches) under edges (a, b), in memory."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
