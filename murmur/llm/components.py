"""Connected components of an edge table, as joins and aggregations.

Large-star / small-star rounds: every node is linked to the smallest node it
knows, until the edges are stars.  Smallest neighbours come from aggregations
that combine map-side, so a hub with a third of all edges costs one row per
task; each round's edges are written to the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import staged

MAX_ROUNDS = 60


def _point_to_smallest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, neighbour) pairs of ``sources`` joined to the node's smallest known node."""
    smallest = (sources.groupBy("node").agg(F.min("other").alias("other"))
                .select(F.col("node").alias("_n"), F.least("node", "other").alias("root")))
    return edges.join(smallest, F.col("node") == F.col("_n"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    larger = both.filter(F.col("other") > F.col("node"))
    return (_point_to_smallest(larger, both).select(F.col("other").alias("a"), F.col("root").alias("b"))
            .filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    linked = _point_to_smallest(down, down)
    return (linked.select(F.col("other").alias("a"), F.col("root").alias("b"))
            .union(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
            .filter("a != b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the ``a``-``b`` edges; root is the smallest node reachable.

    Loops, repeated edges and edges with a null end are dropped; no edges give no rows.
    """
    current = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .distinct(), "components")
    mark = None
    for _ in range(MAX_ROUNDS):
        row = current.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row["n"], row["h"]) or not row["n"]:
            break
        mark = (row["n"], row["h"])
        current = staged(_small_star(_large_star(current)), "components")
    else:
        raise RuntimeError(f"edges did not settle in {MAX_ROUNDS} rounds")
    smallest = current.groupBy("a").agg(F.min("b").alias("root"))
    roots = current.select(F.col("b").alias("node")).distinct()
    return smallest.select(F.col("a").alias("node"), "root").union(roots.select("node", F.col("node").alias("root")))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) with the same components as the edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if np.array_equal(px, py):
            break
        low = np.minimum(px, py)
        np.minimum.at(parent, px, low)
        np.minimum.at(parent, py, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    far = parent != np.arange(len(nodes))
    return nodes[far], nodes[parent[far]]
