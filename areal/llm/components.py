"""Connected components of a table of edges, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.plans.sizing import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node of it.

    Each round takes the least label around a node and then that label's own label,
    so long chains halve. Labels and edges stay in tables; a node with many edges is
    one key of a join whose other side holds it once.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("component")
    ))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        least = labels.union(around).groupBy("node").agg(F.min("component").alias("component"))
        ahead = least.select(F.col("node").alias("_next"), F.col("component").alias("_ahead"))
        jumped = least.join(ahead, F.col("component") == F.col("_next")).select("node", F.col("_ahead").alias("component"))
        before = labels.select("node", F.col("component").alias("_before"))
        marked = checkpoint(jumped.join(before, "node").withColumn("_moved", F.col("component") < F.col("_before")))
        labels = marked.select("node", "component")
        if marked.filter("_moved").isEmpty():
            return labels
