"""Exact histogram of encoded lengths: totals, quantiles and truncated totals for every context limit.

Documents are encoded once and aggregated by length. Suffix sums over the histogram then answer all questions: how
many documents and tokens are at least L long, and how many tokens remain when each document is cut at L. The sums
run in two levels (within blocks of 4,096 lengths, then over the blocks), so no task holds all lengths.

Defined cases: a null or empty text has length 0 and is counted; an empty table gives an empty histogram; identifiers
play no part, so repeated rows count as often as they stand; very long texts are encoded in parts, with the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialise
from .textbytes import slices
from .tokens import encoder

BLOCK = 4096


def encoded_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, edge = encoder(tokenizer_path).encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(edge))], ["length"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Per distinct length: length, n_docs, n_tokens, docs_at_least, tokens_at_least (suffix sums), docs_total,
    tokens_total, tokens_cut (total when every document is cut at this length) and share_below (documents shorter)."""
    lengths = materialise(encoded_lengths(docs, tokenizer_path, text_col).groupBy("length").agg(F.count("*").alias("n_docs")), "length-histogram")
    lengths = lengths.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = lengths.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")), *(F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("d", "t")))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = lengths.join(blocks, "block").withColumns({"docs_at_least": F.sum("n_docs").over(inside) + F.col("d_after"), "tokens_at_least": F.sum("n_tokens").over(inside) + F.col("t_after")})
    cut = F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return out.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", F.col("d_all").alias("docs_total"), F.col("t_all").alias("tokens_total"), cut.alias("tokens_cut"), ((F.col("d_all") - F.col("docs_at_least")) / F.col("d_all")).alias("share_below"))


def cut_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: docs_over (longer documents) and tokens_cut, read off the suffix sums."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    first = F.col("length") > F.col("context_limit")
    totals = histogram.crossJoin(F.broadcast(asked)).groupBy("context_limit").agg(F.max("docs_total").alias("n"), F.max("tokens_total").alias("t"), F.max(F.when(first, F.col("docs_at_least"))).alias("d"), F.max(F.when(first, F.col("tokens_at_least"))).alias("o"))
    over = F.coalesce("d", F.lit(0))
    return totals.select("context_limit", over.alias("docs_over"), (F.col("t") - F.coalesce("o", F.lit(0)) + over * F.col("context_limit")).alias("tokens_cut"))


def length_quantile(histogram: DataFrame, share: float | str) -> DataFrame:
    """The least length L such that at least ``share`` of the documents are not longer than L. The share counts as it is
    written (0.07 is 7 of 100), in whole numbers."""
    part = Fraction(str(share))
    upto = (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")).cast("decimal(38,0)")
    enough = upto * F.lit(part.denominator).cast("decimal(38,0)") >= F.col("docs_total").cast("decimal(38,0)") * F.lit(part.numerator).cast("decimal(38,0)")
    return histogram.filter(enough).agg(F.min("length").alias("length"))
