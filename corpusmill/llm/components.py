"""Connected components of a graph of links, by min-label propagation with pointer jumping, all in Spark.

The label of a node falls to the smallest label next to it, then to the label of its label, until nothing changes.
Each round is written to shared storage; only a count of changes reaches the driver. A node with very many links is
one row of labels and its links split over tasks in the joins (both sides are plain shuffles, which adaptive execution
splits where skewed) before a combining aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): label is the smallest node of its component; only linked nodes appear."""
    links = links.filter(F.col("a") != F.col("b"))
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        offered = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        met = labels.join(offered, "node").select("node", F.least("label", "offer").alias("label"), F.col("label").alias("old"))
        up = met.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = materialise(met.join(up, "label").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") < F.col("old")).alias("fell")), "labels")
        labels = new.select("node", "label")
        if new.filter("fell").isEmpty():
            return labels


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) after more links(a, b): only components that these join are looked at again."""
    name = lambda c: F.coalesce(F.col(f"label_{c}"), F.col(c)).alias(c)
    between = links.join(labels.toDF("a", "label_a"), "a", "left").join(labels.toDF("b", "label_b"), "b", "left").select(name("a"), name("b"))
    new = connected_components(between).toDF("label", "above")
    known = labels.join(new, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    added = new.toDF("node", "label").join(labels.select("node"), "node", "left_anti")
    return materialise(known.union(added), "labels")
