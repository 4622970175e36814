"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of its component.

    Each round takes the least label among the neighbours, then follows labels twice; it ends when
    no label changes. Labels are written each round, so a lost executor costs one round at most.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        for _ in range(2):
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            lower = lower.join(up, "label").select("node", "was", F.least("label", "up").alias("label"))
        lower = materialise(lower)
        labels = lower.select("node", "label")
        if not lower.where("label <> was").limit(1).count():
            return labels
