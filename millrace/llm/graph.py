"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with partial minima and two joins on the vertex;
a vertex with very many edges is split by the adaptive skew join.  A round's
edges are written to the shared folder, so lineage stays short.  The driver
sees one count and one checksum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the edges given, without the roots."""
    nodes, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): the smallest node that
    each node other than the smallest of its component reaches.  Self-loops and
    repeated edges are allowed."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.select(big.alias("a"), small.alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(rest.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
