"""Scanning note trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that are never entered, besides those with a leading dot.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "target")


def prune(paths: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rows (source, path) that are exact ``*.md`` outside dot directories and skipped ones."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda s: s.startswith(".") | s.isin(*skipped))
    return paths.filter(F.col("path").endswith(".md") & ~bad)


def scan_notes(spark: SparkSession, sources: dict[str, str], skipped: tuple[str, ...] = SKIPPED, with_content: bool = True) -> DataFrame:
    """(source, path, content) of the Markdown files under each source's root. Without content only names are read,
    so that domains can be derived before any file is opened."""
    out = None
    for name, root in sources.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
        path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), rf"^(?:[a-z]+:)?/*\Q{base}\E/", "")
        rows = files.select(F.lit(name).alias("source"), path.alias("path"), *([F.decode("content", "UTF-8").alias("content")] if with_content else []))
        out = rows if out is None else out.unionByName(rows)
    return prune(out, skipped)
