"""The query catalogue: every registered query over the driver's tables, and its SQL."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import options, retrieval, structure, upkeep

_MODULES = (structure, retrieval, upkeep, options)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

_shipped: set[str] = set()


def ship(spark: SparkSession, root: Path) -> None:
    """Adds the package to the executors' path, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='corpusmill-')}/corpusmill", "zip", root, "corpusmill")
        spark.sparkContext.addPyFile(archive)
