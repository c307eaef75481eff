"""Connected components of an edge table, by hooking and pointer jumping over tables.

Every node hooks to its least neighbour if that is smaller; pointers are jumped until they reach a
root; edges are relabelled with the roots and those within a component go. This repeats while edges
are left, a number of rounds logarithmic in the nodes. Nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwritten, written


def rooted(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent < node for some and parent = node for roots: (node, root)."""
    current = written(parents)
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
        jumped = written(current.join(up, "parent", "left").select("node", F.coalesce("higher", "parent").alias("parent"), F.coalesce(F.col("higher") < F.col("parent"), F.lit(False)).alias("moved")))
        moved = not jumped.filter("moved").isEmpty()
        unwritten(current)
        current = jumped
        if not moved:
            return current.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. One row per node that has an edge: node, component (the least node reachable)."""
    left, labels = written(edges.filter("a != b").select("a", "b")), None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        roots = rooted(least.select("node", F.least("node", "least").alias("parent")))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            onward = roots.select(F.col("node").alias("component"), F.col("parent").alias("next"))
            labels = written(labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        for end in ("a", "b"):
            left = left.join(roots.select(F.col("node").alias(end), F.col("parent").alias("root")), end).drop(end).withColumnRenamed("root", end)
        left = written(left.filter("a != b").distinct())
        if left.isEmpty():
            return labels
