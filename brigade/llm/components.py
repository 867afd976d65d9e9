"""Connected components of links held in DataFrames, without collecting any of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def _stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links and the smallest node that these links join it to."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[x], low[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[low]
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _contract(batches, most: int = 1 << 20):
    """A task's links (x, y) with those that lead each of its nodes to the smallest of those it is
    joined to there in their place, so at most one for a node; a node joined to none links to itself.
    Beyond ``most`` different nodes a task begins anew."""
    held, size = [], 0

    def stars():
        nodes, low = _stars(*(np.concatenate(c) for c in zip(*held)))
        # a smallest node is named by the others' links
        named = np.zeros(len(nodes), bool)
        named[np.searchsorted(nodes, low[low != nodes])] = True
        return nodes[~named], low[~named]

    def rows(x, y):
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= 2 * most:
            held = [stars()]
            size = len(held[0][0])
            if size >= most:
                yield rows(*held[0])
                held, size = [], 0
    if size:
        yield rows(*stars())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternating star contraction: every node hands its smallest neighbour to its other neighbours,
    so the depth of a component halves in a round. Links that meet in a task, of the input or of a
    round, are contracted there first, which takes most of the rounds away. Minima are combined before they are shuffled,
    each round is written to the shared folder, and the joins are between plain tables, whose
    large partitions Spark splits. A self-link only names a node.
    """
    edges = stash(links.select(F.col(a).alias("x"), F.col(b).alias("y")).mapInArrow(_contract, "x long, y long"), "edges")
    while True:
        every = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = stash(every.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.max(F.when(F.col("y") != F.col("x"), F.col("y"))).alias("most")), "low")
        # settled when who has a neighbour below has no other
        if low.where("m < x and most <> m").isEmpty():
            return low.select(F.col("x").alias("node"), F.col("m").alias("component"))
        # large star: neighbours above a node link to the node's smallest neighbour or itself
        large = every.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # small star: links that a node has to those below it meet in one task
        met = large.unionByName(low.select("x", F.col("m").alias("y"))).repartition("x")
        edges = stash(met.mapInArrow(_contract, "x long, y long"), "edges")
