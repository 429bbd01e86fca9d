"""Connected components: a distributed union-find over edge tables, and a small one inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import materialise


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given edges and for each the smallest node it can reach."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root = higher


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``, root being the smallest node of its component.

    Alternates two steps until only stars are left. First every node hands its larger neighbours to the smallest node
    it sees, then every node hands its smaller neighbours to the smallest of them. Rounds grow with the logarithm of the
    longest chain. The minima are combined before the shuffle, and the join back is one whose skewed partitions Spark
    splits, so a hub with a third of all edges is no single task. Each round is written to the shared folder, so an
    executor's loss costs one round at most.
    """
    current = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while True:
        roles = current.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
            current.select("v", F.lit(0), F.lit(1))
        )
        knots = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if knots.filter("child > 1 OR (child = 1 AND parent = 1)").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        wide = materialise(wide, label)
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        current = materialise(narrow.filter("u != v").distinct(), label)
