"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Between stages the rows are written as Parquet and read again.

Defined cases of every stage: null and empty texts are empty texts and pass like any other (one of them stays after
exact copies, none links to another text, none is contaminated); rows with a null identifier are judged by their text
and never dropped as near copies; repeated rows count as copies; very long texts are read whole; an empty table gives an
empty one; columns that ``documents`` doesn't have are passed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from corpusmill.llm.queries import table, tokenizer
from corpusmill.llm.store import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it learns from the labelled ones that are not held out."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z/a-z, the document with the largest id."""
    return exact_dedup.keep_distinct(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    return near_dedup.keep_one_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", distinct_texts), ("near_dedup", distinct_content), ("decontaminate", uncontaminated), ("bpe", tokens)]

#: The classifier and the tokenizer can't be written in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
