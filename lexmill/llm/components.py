"""Connected components of a link table, in distributed rounds of two joins.

Each round lets every vertex point its larger neighbours at the smallest vertex
around it, then its smaller neighbours too (the alternating star contraction).
The number of rounds grows with the logarithm of the longest chain.  Rounds are
written to the shared folder, so a lost executor costs one round, and only
counts reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) of all
    nodes in a link to another node.  Null ends and self links are ignored;
    repeated links change nothing; without links the result is empty."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = materialize(edges.distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node that points at none."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
    ends = edges.select(F.col("u").alias("v"))
    return n["n"] == n["u"] and edges.join(ends, "v", "left_semi").isEmpty()


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable for each of ``n`` indices over links ``a - b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
