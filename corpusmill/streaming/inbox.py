"""Inbox capture as a stream: an append-only log of captured lines, in order of arrival, exactly once per checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import capture_line


def read_inbox(spark: SparkSession, path: str, schema: str, format_: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format_).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def captured(inbox: DataFrame, keep: list[str]) -> DataFrame:
    """inbox(ts string, text, *keep) -> (*keep, day, line); blank texts are dropped. Works on tables and streams."""
    return inbox.withColumn("line", capture_line(F.col("ts"), F.col("text"))).filter("line is not null").select(*keep, F.substring("ts", 1, 10).alias("day"), "line")


def write_inbox(lines: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends lines to a table partitioned by day."""
    writer = lines.writeStream.format("parquet").outputMode("append").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
