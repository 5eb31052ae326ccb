"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundsieve.sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for the nodes of the
    undirected edges (a, b). Labels spread to neighbours and jump to the label of
    their label, so the number of rounds grows with the logarithm of a
    component's width. Every round is a table that outlives executors."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("there")), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("there").alias("there"))
        spread = stage(labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "there").alias("label")), "labels")
        above = spread.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stage(spread.join(above, "label", "left").select(
            "node", "before", F.least("label", "above").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> before").isEmpty():
            return labels
