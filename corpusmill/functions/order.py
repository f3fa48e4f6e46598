"""Positions in an order, without a task that sees all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialise


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with n: 1, 2, .. by ``order`` within each key. Range partitions are sorted and written, each counts its rows
    of a key, and sums over the partitions before it number them: a key with most of the rows is cut like any other.
    Rows that are alike in key and order are numbered in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, by = F.monotonically_increasing_id(), [*key, *order]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = materialise(ranged.withColumn("__part", F.shiftright(place, 33)).withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = ranged.groupBy(*key, "__part").agg(F.count("*").alias("__here"), F.min("__place").alias("__first"))
    upto = Window.partitionBy(*key).orderBy("__part")  # one row a partition
    counts = counts.select(*key, "__part", (F.sum("__here").over(upto) - F.col("__here") - F.col("__first") + 1).alias("__shift"))
    return ranged.join(counts, [*key, "__part"]).withColumn("n", F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")
