"""Incremental synchronisation driven by a stream of changed documents.

Each micro-batch plans only its own documents and rewrites only the buckets of points that it changes, published as a new
version of the point table. A replayed batch plans nothing but ``unchanged``, as ids follow from identities and hashes from
texts, and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.semantic import embed_rows
from ..operators.sync import apply_to, desired_points
from ..sources.keyed import KeyedTable


def latest(changes: DataFrame) -> DataFrame:
    """The last version of each identity in a batch, by ``version``."""
    order = Window.partitionBy("identity").orderBy(F.desc("version"), F.desc("compiled_hash"))
    return changes.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "version")


def sync_batch(changes: DataFrame, points: KeyedTable, embed: Callable, dim: int) -> tuple[DataFrame, int]:
    """(plan, buckets written) for one batch of changed documents; deletions aren't part of a change stream."""
    return apply_to(points, desired_points(latest(changes)), lambda rows: embed_rows(rows, embed, dim))


def stream_sync(changes: DataFrame, points: KeyedTable, embed: Callable, dim: int, checkpoint: str) -> StreamingQuery:
    """Keeps ``points`` (keyed by point_id) in step with a stream of changed documents."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sync_batch(rows, points, embed, dim)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
