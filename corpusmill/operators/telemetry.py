"""Call statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def call_stats(calls: DataFrame) -> DataFrame:
    """calls(verb, duration_ms, exit_code) -> per verb: n, p50_ms, p95_ms, max_ms, error_rate. Rows without a verb
    don't count. Percentiles are discrete ones, from counts per (verb, duration) and their running sums, so no task
    holds a verb's durations at once."""
    rows = calls.filter(F.coalesce("verb", F.lit("")) != "")
    fault = F.when(F.col("exit_code") != 0, 1).otherwise(0)
    counts = rows.groupBy("verb", "duration_ms").agg(F.count("*").alias("c"), F.sum(fault).alias("faults"))
    timed = counts.filter("duration_ms is not null")
    upto = F.sum("c").over(Window.partitionBy("verb").orderBy("duration_ms"))
    all_ = F.sum("c").over(Window.partitionBy("verb"))
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("duration_ms")))
    times = timed.withColumns({"upto": upto, "all": all_}).groupBy("verb").agg(q(50).alias("p50_ms"), q(95).alias("p95_ms"), F.max("duration_ms").alias("max_ms"))
    total = counts.groupBy("verb").agg(F.sum("c").alias("n"), (F.sum("faults") / F.sum("c")).alias("error_rate"))
    return total.join(times, "verb", "left").select("verb", "n", "p50_ms", "p95_ms", "max_ms", "error_rate")


def recent_faults(calls: DataFrame, most: int = 5) -> DataFrame:
    """The last faults of each verb."""
    rows = calls.filter((F.coalesce("verb", F.lit("")) != "") & (F.col("exit_code") != 0))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("verb").orderBy(F.desc("ts"), "message"))).filter(F.col("n") <= most)
