"""Multi-field BM25 over a postings table.

Postings and statistics are kept per source and field (``profile v1``) or over one global corpus (``v2``); a batch of
queries is joined to the postings by term, summed by field weight, masked by facets after scoring, and cut to the top.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, natural_tokens, slug_tokens

#: Weights of the fields.
WEIGHTS = {"title": 5.0, "body": 1.0, "identity": 2.0, "source_path": 2.0}
SLUG_FIELDS = ("identity", "source_path")
K1, B = 1.5, 0.75
GLOBAL = "*"


def lexical_fields(docs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """(source, identity, title, body, source_path, others): body is description, keywords and text together."""
    body = F.concat_ws(" ", "description", F.array_join("keywords", " "), "body_text")
    return docs.select("source", "identity", "title", body.alias("body"), "source_path", *others)


def postings(fields: DataFrame, profile: str = "v1", natural: Callable[[Column], Column] = natural_tokens, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(corpus, field, term, source, identity, tf): the corpus is the source, or one for all under ``v2``."""
    corpus = F.col("source") if profile == "v1" else F.lit(GLOBAL)
    token = lambda f: (slug_tokens if f in SLUG_FIELDS else natural)(F.coalesce(F.col(f), F.lit("")))
    every = F.array(*(F.struct(F.lit(f).alias("field"), token(f).alias("terms")) for f in weights))
    rows = fields.select(corpus.alias("corpus"), "source", "identity", F.inline(every))
    return rows.select("corpus", "field", F.explode("terms").alias("term"), "source", "identity").groupBy("corpus", "field", "term", "source", "identity").agg(F.count("*").alias("tf"))


def field_lengths(fields: DataFrame, profile: str = "v1", natural: Callable[[Column], Column] = natural_tokens, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(corpus, field, tf): the tokens of each field of each document, if any, as one row: what ``field_stats`` sums, without
    a shuffle of postings."""
    corpus = F.col("source") if profile == "v1" else F.lit(GLOBAL)
    return token_lists(fields, natural, weights).select(corpus.alias("corpus"), "field", F.col("dl").alias("tf")).filter("tf > 0")


def field_stats(fields: DataFrame, posted: DataFrame, profile: str = "v1") -> DataFrame:
    """(corpus, field, n_docs, avgdl) from postings, or from ``field_lengths``: empty fields count as documents of length zero."""
    corpus = F.col("source") if profile == "v1" else F.lit(GLOBAL)
    n = fields.groupBy(corpus.alias("corpus")).agg(F.count("*").alias("n_docs"))
    total = posted.groupBy("corpus", "field").agg(F.sum("tf").alias("total"))
    return total.join(n, "corpus").select("corpus", "field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avgdl"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("corpus", "field", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, natural: Callable[[Column], Column] = natural_tokens, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, field, term, n): a repeated query term counts as often as it stands."""
    text = F.coalesce("text", F.lit(""))
    every = F.array(*(F.struct(F.lit(f).alias("field"), (slug_tokens if f in SLUG_FIELDS else natural)(text).alias("terms")) for f in weights))
    rows = queries.select("query_id", F.inline(every)).select("query_id", "field", F.explode("terms").alias("term"))
    return rows.groupBy("query_id", "field", "term").agg(F.count("*").alias("n"))


def token_lists(fields: DataFrame, natural: Callable[[Column], Column] = natural_tokens, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(source, identity, field, terms, dl): the tokens of each field of each document and their number. Lengths,
    statistics and postings of any profile come from this one table, so texts are tokenised once."""
    token = lambda f: (slug_tokens if f in SLUG_FIELDS else natural)(F.coalesce(F.col(f), F.lit("")))
    every = F.array(*(F.struct(F.lit(f).alias("field"), token(f).alias("terms")) for f in weights))
    return fields.select("source", "identity", F.inline(every)).withColumn("dl", F.size("terms"))


def bm25_scores(queries: DataFrame, tokens: DataFrame, profile: str = "v1", natural: Callable[[Column], Column] = natural_tokens, weights: dict[str, float] = WEIGHTS, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, source, identity, score) of every document with a query term; scores above zero only.

    Only tokens that are query terms leave the scan. Each posting gets its share of a score once, whatever the number of
    queries; postings are then dealt by document, so that sums over a query's terms need no further shuffle where
    the query terms are small enough for Spark to broadcast."""
    terms = query_terms(queries, natural, weights)
    wanted = terms.select("field", "term").distinct()
    corpus = F.col("source") if profile == "v1" else F.lit(GLOBAL)
    stats = tokens.groupBy(corpus.alias("corpus"), "field").agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    posted = tokens.select("source", "identity", "field", "dl", F.explode("terms").alias("term")).join(wanted, ["field", "term"], "left_semi")
    posted = posted.groupBy("source", "identity", "field", "term", "dl").agg(F.count("*").alias("tf")).withColumn("corpus", corpus)
    rows = posted.join(document_frequencies(posted), ["corpus", "field", "term"]).join(stats, ["corpus", "field"])
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight[F.col("field")] * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    dealt = rows.select("source", "identity", "field", "term", part.alias("part")).repartition("source", "identity")
    return dealt.join(terms, ["field", "term"]).groupBy("query_id", "source", "identity").agg(F.sum(F.col("n") * F.col("part")).alias("score")).filter("score > 0")


def facet_mask(docs: Column | None = None, tag_folder: Callable[[Column], Column] = fold) -> Column:
    """Whether a document row passes the query's facets; null or blank facets pass all. Needs the query columns
    q_domain, q_kind, q_status, q_tag beside the document's domain_prefixes, kind, status, keywords."""
    clean = lambda c: F.trim(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("/"))
    free = lambda c: clean(c) == ""
    tags = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)
    return (
        (free("q_domain") | F.array_contains("domain_prefixes", clean("q_domain")))
        & (free("q_kind") | (F.col("kind") == clean("q_kind")))
        & (free("q_status") | (F.coalesce("status", F.lit("")) == clean("q_status")))
        & (free("q_tag") | F.array_contains(tags, F.lower(clean("q_tag"))))
    )


def with_facets(scored: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Drops scored rows that the query's facets refuse: after scoring, before any cut."""
    facets = queries.select("query_id", *(F.col(c).alias(f"q_{c}") for c in ("domain", "kind", "status", "tag")))
    facts = docs.select("source", "identity", "domain_prefixes", "kind", "status", "keywords")
    return scored.join(facets, "query_id").join(facts, ["source", "identity"]).filter(facet_mask()).select(scored.columns)


def top_k(scored: DataFrame, k: int, per: list[str] | None = None) -> DataFrame:
    """Best k by score per query (and ``per``); ties by source and identity. Adds rank."""
    window = Window.partitionBy("query_id", *(per or [])).orderBy(F.desc("score"), "source", "identity")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(scored: DataFrame, k: int) -> DataFrame:
    """Top k of each source, merged on raw scores, cut to k."""
    return top_k(top_k(scored, k, ["source"]).drop("rank"), k)


def narrow(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """Keeps the source that a query asks for, where it asks for one."""
    asked = queries.select("query_id", F.nullif(F.trim("source"), F.lit("")).alias("asked"))
    return scored.join(asked, "query_id").filter(F.col("asked").isNull() | (F.col("asked") == F.col("source"))).drop("asked")


def unknown_sources(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries that ask for a source that isn't there; a caller treats any row as an error."""
    asked = queries.select("query_id", "source").filter(F.trim(F.coalesce("source", F.lit(""))) != "")
    return asked.join(docs.select("source").distinct(), "source", "left_anti")
