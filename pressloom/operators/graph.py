"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.runtime import HUB, cut, hot_join


def components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """(node, component): component is the smallest node id that is reachable. Null ends and self-loops are no edges;
    a node of self-loops only is not returned, nor is any node of an empty edge table.

    Each round points every node at its smallest neighbour (a partial, map-side aggregate), merges the nodes that
    pointers join, and keeps only the edges between different merged nodes; a star of any size vanishes in one round
    and the edge table shrinks at least by half. A hub's edges are spread over tasks (``hot_join``). Nothing but row
    counts reaches the driver; every round is written to the shared folder, so that lost executors cost no more than one round.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    where = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")))
        # two pointer jumps: chains of pointers lead downwards, so every jump stays within the component
        for _ in range(2):
            step = to.select(F.col("a").alias("to"), F.col("to").alias("further"))
            to = cut(hot_join(to, step, "to", hub=hub).select("a", F.coalesce("further", "to").alias("to")))
        if where is None:
            where = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            step = to.select(F.col("a").alias("component"), F.col("to").alias("further"))
            where = cut(hot_join(where, step, "component", hub=hub).select("node", F.coalesce("further", "component").alias("component")))
        left, right = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        half = cut(hot_join(e, left, "a", "inner", hub).select("b", "x"))
        e = hot_join(half, right, "b", "inner", hub).filter("x <> y")
        e = cut(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if where is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return where
