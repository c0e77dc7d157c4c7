"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (x, y): label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so chains
    halve. Rounds end when nothing changes; each is stored, and groupings combine before their shuffle, so a
    node with very many links costs one row per task.
    """
    both = store(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = store(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = store(step.join(jump, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
