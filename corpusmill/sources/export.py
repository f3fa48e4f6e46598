"""Export of ranked hits with the text of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_hits(hits: DataFrame, docs: DataFrame, max_chars: int = 0) -> DataFrame:
    """hits(query_id, source, identity, rank, score) with text (title, description, body joined by a blank line),
    n_chars and truncated; ``max_chars`` of 0 cuts nothing."""
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    joined = hits.join(docs.select("source", "identity", "title", "description", "body_text"), ["source", "identity"], "left")
    text = F.concat_ws("\n\n", part("title"), part("description"), part("body_text"))
    rows = joined.withColumn("full", text).withColumn("n_chars", F.length("full"))
    cut = F.substring("full", 1, max_chars) if max_chars else F.col("full")
    return rows.select("query_id", "rank", "source", "identity", "score", cut.alias("text"), "n_chars", (F.col("n_chars") > max_chars if max_chars else F.lit(False)).alias("truncated"))


def write_hits(exported: DataFrame, path: str) -> None:
    exported.write.mode("overwrite").json(path)
