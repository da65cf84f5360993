"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least neighbour: the larger ones (large star) or the smaller ones.

    The least neighbours are written before they meet the edges again, so that the join's sides
    are both plain tables and a hub's rows can be split.
    """
    if large:
        arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        out = arcs.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = edges.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(
            least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of (``a``, ``b``) edges, the root itself included: root
    is the least node of the component.

    Edges are kept as (greater, lesser). Large and small stars alternate until the edges stop
    changing; then every edge points at its root. The rounds follow the logarithm of the longest
    path. Only counts and checksums reach the driver. Loops and repeated edges do no harm; an
    empty table gives none; an edge with a null end is none.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        edges = stored(_stars(stored(_stars(edges, True), "stars"), False), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(F.shiftright(digest, 24))).first())


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of some pairs, inside a task: no more than nodes, however many
    pairs there are. Loops are no edges."""
    other = left != right
    left, right = left[other], right[other]
    if not left.size:
        return np.empty((0, 2), left.dtype)
    nodes, code = np.unique(np.stack([left, right]), return_inverse=True)
    x, y = code.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:  # hang the greater root below the lesser, then shorten the paths
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while (root != root[root]).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[hung], nodes[root[hung]]], 1)
