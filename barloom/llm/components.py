"""Connected components of an undirected edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    edges = edges.where("a <> b")
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the ends of ``(a, b)``; the root is the smallest node reachable.

    Every round points each node at its smallest neighbour, or itself, takes one
    more step along these pointers, and replaces the ends of every edge by what
    they point at.  Loops and repeated edges go, so rounds work on ever fewer
    edges; the pointers are then followed back from the last round to the first.
    Each round is written and read again.  Neighbours are combined before the
    shuffle, so a node with very many edges costs one row per task.
    """
    rounds = []
    edges = stored(_both_ways(edges))
    while True:
        near = stored(
            edges.groupBy("a").agg(F.min("b").alias("low")).select(
                F.col("a").alias("node"), F.least("a", "low").alias("points")
            )
        )
        if near.isEmpty():
            break
        onward = near.select(F.col("node").alias("points"), F.col("points").alias("root"))
        pointers = stored(near.join(onward, "points").select("node", "root"))
        rounds.append(pointers)
        ends = [pointers.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        # an edge stands in both directions; one of them is enough from here on
        moved = edges.where("a < b").join(ends[0], "a").join(ends[1], "b")
        edges = stored(_both_ways(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))))
    if not rounds:
        return near.select("node", F.col("points").alias("root"))
    labels = rounds[-1]
    for pointers in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("root"), F.col("root").alias("last"))
        labels = stored(
            pointers.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        )
    return labels
