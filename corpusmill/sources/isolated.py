"""Steps of many sources that fail one by one: what a step gives is written, what it raises is a row.

Each source's step (a reader, a compilation) is run and written under a folder of its own, several at a time; an error,
whether while planning or in a task, ends that source alone. All that succeeded is then one table, read in one scan, and all
that failed a table (source, step, error) that reports, prunes and exit classes take. An attempt that failed leaves files that
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .storage import new_path

FAILURES = "source string, step string, error string"
#: Characters of an error that are kept.
ERROR_CHARS = 500


def run_isolated(spark: SparkSession, step: str, steps: Mapping[str, Callable[[], DataFrame]], schema: str, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): the rows of all steps that succeeded, with this schema, and a row for each source whose step did not.
    The driver keeps one path or one error a source."""
    root = new_path(spark, f"isolated-{step}")

    @inheritable_thread_target(spark)
    def attempt(number: int, source: str) -> tuple[str, str | None]:
        path = f"{root}/{number}"
        try:
            rows = steps[source]()
            rows.select(*(f.name for f in wanted.fields)).to(wanted).write.mode("overwrite").option("compression", "zstd").parquet(path)
        except Exception as e:  # the failure is a row
            text = str(e).strip() or type(e).__name__
            return source, text[:ERROR_CHARS]
        good[source] = path
        return source, None

    good: dict[str, str] = {}
    wanted = spark.createDataFrame([], schema).schema
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        outcome = list(pool.map(attempt, range(len(steps)), steps))
    failures = spark.createDataFrame([(s, step, e) for s, e in outcome if e is not None], FAILURES)
    paths = [good[s] for s in steps if s in good]
    rows = spark.read.schema(wanted).parquet(*paths) if paths else spark.createDataFrame([], wanted)
    return rows, failures
