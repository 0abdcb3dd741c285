"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) with the components of the given edges."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new[x] = np.minimum(new[x], new[root[x]])
        new[y] = np.minimum(new[y], new[root[y]])
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each batch by the stars of their components."""
    for b in batches:
        u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges with u > v. The centre's least neighbour meets the neighbours in
    a join of which one side has a row per node, so a centre of high degree can be split."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, dense: bool = True) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the least node reached.

    Ends when a round changes nothing; nodes without edges don't appear. ``dense`` thins the edges
    batch by batch first, which those that come as stars don't need.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut((e.mapInArrow(_local, "u bigint, v bigint") if dense else e).distinct())
    while True:  # the stars settle in a number of rounds that grows with the square of the logarithm
        # Done when every edge is a star edge: no centre is itself a leaf.
        if e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = cut(_stars(cut(_stars(e, small=False)), small=True))
