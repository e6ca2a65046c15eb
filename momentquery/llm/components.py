"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, written


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the smallest node that is reachable. Nodes without edges don't appear.

    Each round gives every node the smallest label among its own, its neighbours' and that of its label, so paths
    halve; labels are written after each round, and the only number that reaches the driver is how many changed.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        # Every node has edges, so one grouping brings its own label and its neighbours' together.
        own = labels.select(F.col("node").alias("a"), "component", F.col("component").alias("_was"))
        told = both.join(labels, F.col("b") == F.col("node")).select("a", "component", F.lit(None).cast("long").alias("_was"))
        near = own.unionByName(told).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"), F.min("_was").alias("_was"))
        jump = labels.select(F.col("node").alias("_node"), F.col("component").alias("_jump"))
        step = near.join(jump, F.col("_was") == F.col("_node"), "left").select("node", F.least("_near", "_jump").alias("component"), "_was")
        step = written(step, "labels")
        changed = step.filter("component <> _was").limit(1).count()
        labels = step.drop("_was")
        # Rounds are small queries, whose plans would pile up in a driver that finds no reason to collect them.
        settled(edges.sparkSession)
        if not changed:
            return labels
