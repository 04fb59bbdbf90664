"""Connected components by alternating large and small stars, in DataFrame operations.

Every step joins edges with the least neighbour of a node, so a node with very many neighbours is only ever a join key that
Spark can split. Each round is written to the shared folder; the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def least_connected(m: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number below m that each number is connected to by the edges (u, v); for edges of one task."""
    label = np.arange(m)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, and that to a node that has none."""
    r = edges.join(edges.select(F.col("a").alias("__up")).distinct(), F.col("b") == F.col("__up"), "left").agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes"), F.count("__up").alias("up")).first()
    return r["up"] == 0 and r["n"] == r["nodes"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the least node that each node reaches. Nodes that are least themselves are left out."""
    # written first: a round reads its edges several times, and finding them may be most of the work
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        now = written(_small(_large(now)), "edges")
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
