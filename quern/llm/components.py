"""Connected components of an edge table, by least labels and pointer jumping over settled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the settled table edges (a, b); label is the least node of its component.

    Each round hands labels over edges, then lets every node take its label's label, so rounds grow with the logarithm
    of a component's diameter.  Only the number of changed labels reaches the driver.  All tables that meet in a join
    are settled, so that adaptive execution can split a node or label that many rows share.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = shared.settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        lower = shared.settle(labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label")), "labels")
        target = lower.select(F.col("node").alias("n"), F.col("label").alias("l"))
        jumped = shared.settle(lower.join(target, F.col("label") == F.col("n")).select("node", F.col("l").alias("label")), "labels")
        moved = jumped.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").count()
        shared.drop_table(lower)
        shared.drop_table(labels)
        labels = jumped
        if not moved:
            return labels
