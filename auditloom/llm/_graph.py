"""Connected components of a graph given as edges, by alternating star operations on shuffled tables.

Large star joins each larger neighbour of a node to the smallest node it touches, small star does so for the
smaller ones. Both are a minimum per node (combined before the shuffle) and a join, so a node with very many
neighbours is split by the adaptive skew join and never gathered. Rounds are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._store import drop, save


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: (u, v) in both directions. Join u's larger neighbours, or its smaller ones and itself, to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger:
        return edges.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.filter("v < u")
    return down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("m < u").select("u", F.col("m").alias("v")))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: long); root is the smallest node reachable."""
    now = save(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        large = _star(_both(now), True).filter("u != v").distinct()
        new = save(_star(_both(large), False).filter("u != v").distinct(), "edges")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now, before, state = new, state, tuple(row)
        if state == before or not state[0]:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges a-b connect among nodes 0 to n - 1, at most n - 1 of them."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]
