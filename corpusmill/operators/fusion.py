"""Query planning, stale gating, weighted reciprocal-rank fusion, recall and its health record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CJK, collapse, point_id

#: The constant of the fusion, how many hits of a lane count, how many a bounded vector search gives.
RRF_K, DEPTH = 60, 320
RAW_DEPTH = 5 * DEPTH
LOW_ANCHOR_WEIGHT = STRONG_ANCHOR_WEIGHT = 2.0
STRONG_TOKENS = 2
#: Tiers of the kind prior.
KIND_TIERS = {"spec": 1, "reference": 1, "runbook": 1, "decision": 2, "index": 2, "research": 3, "note": 4}
LAST_TIER = 4
KEY = ["query_id", "source", "identity"]


def query_features(queries: DataFrame, protect: bool = True) -> DataFrame:
    """Queries with n_cjk, n_identifiers, n_code, low_anchor, strong_anchor, w_lexical and w_semantic."""
    text = F.coalesce("text", F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_:\-]*)"), 1)
    code = F.filter(runs, lambda t: t.rlike(r"[0-9_:\-]") | (t.rlike("[a-z]") & t.rlike("[A-Z]")) | (t.rlike("[A-Z]") & ~t.rlike("[a-z]") & (F.length(t) >= 2)))
    rows = queries.withColumns({"n_cjk": F.regexp_count(text, F.lit(CJK)), "n_identifiers": F.size(runs), "n_code": F.size(code)})
    rows = rows.withColumns({"low_anchor": (F.col("n_cjk") > 0) & (F.col("n_identifiers") == 0), "strong_anchor": F.col("n_code") >= STRONG_TOKENS})
    return rows.withColumns({"w_lexical": F.when(F.lit(protect) & F.col("strong_anchor"), STRONG_ANCHOR_WEIGHT).otherwise(1.0), "w_semantic": F.when(F.col("low_anchor"), LOW_ANCHOR_WEIGHT).otherwise(1.0)})


def stale_reason() -> Column:
    """Why a semantic hit (h_* columns) is stale against its document (d_* columns, d_identity null if missing); null
    keeps it. Fixed values: these reasons, in this order."""
    return (
        F.when(F.col("h_unit_mode").isNull() & F.col("h_text_hash").isNull(), None)
        .when(F.col("d_identity").isNull(), "compiled_doc_missing")
        .when(F.col("d_compiled_hash").isNull(), None)
        .when(~F.col("h_unit_mode").eqNullSafe(F.lit("whole")), "embedding_unit_mismatch")
        .when(F.coalesce("h_text_hash", F.lit("")) == "", "text_hash_missing")
        .when(F.col("h_source_hash").isNotNull() & ~F.col("h_source_hash").eqNullSafe(F.col("d_source_hash")), "source_hash_mismatch")
        .when(~F.col("h_compiled_hash").eqNullSafe(F.col("d_compiled_hash")), "compiled_hash_mismatch")
    )


def gate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Semantic hits(query_id, source, identity, score, unit_mode, text_hash, source_hash, compiled_hash) with reason."""
    h = hits.select(*KEY, "score", *(F.col(c).alias(f"h_{c}") for c in ("unit_mode", "text_hash", "source_hash", "compiled_hash")))
    d = docs.select("source", "identity", F.col("identity").alias("d_identity"), F.col("source_hash").alias("d_source_hash"), F.col("compiled_hash").alias("d_compiled_hash"))
    return h.join(d, ["source", "identity"], "left").select(*KEY, "score", stale_reason().alias("reason"))


def ranked(hits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Dense 1-based ranks per query of what is left."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "identity"))).filter(F.col("rank") <= depth)


def fuse(lexical: DataFrame, semantic: DataFrame, weights: DataFrame, k: int, docs: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """Top k by sum of weight / (60 + rank) over the union of both lanes, with a vote of each document's kind if
    ``docs`` is given: (query_id, source, identity, score, lexical_rank, semantic_rank, rank)."""
    a = ranked(lexical, depth).select(*KEY, F.col("rank").alias("lexical_rank"))
    b = ranked(semantic, depth).select(*KEY, F.col("rank").alias("semantic_rank"))
    both = a.join(b, KEY, "full").join(weights.select("query_id", "w_lexical", "w_semantic"), "query_id")
    vote = lambda w, r: F.coalesce(F.col(w) / (RRF_K + F.col(r)), F.lit(0.0))
    score = vote("w_lexical", "lexical_rank") + vote("w_semantic", "semantic_rank")
    if docs is not None:
        tier = F.coalesce(F.create_map(*(F.lit(x) for pair in KIND_TIERS.items() for x in pair))[F.col("kind")], F.lit(LAST_TIER))
        both = both.join(docs.select("source", "identity", "kind"), ["source", "identity"], "left")
        score = score + 1.0 / (RRF_K + tier)
    rows = both.select(*KEY, score.alias("score"), "lexical_rank", "semantic_rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "identity"))).filter(F.col("rank") <= k)


def enrich(hits: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with title, path, abs_path, status, kind, legacy flags, preview (160 characters of collapsed body) and a
    score of six digits."""
    d = docs.select("source", "identity", "title", "source_path", "status", "kind", "keywords", F.substring(collapse(F.col("body_text")), 1, 160).alias("preview"))
    s = sources.select("source", "root", "legacy")
    rows = hits.join(d, ["source", "identity"], "left").join(s, "source", "left")
    flags = {f: F.coalesce(F.array_contains("keywords", f), F.lit(False)) for f in ("raw", "unverified")}
    return rows.withColumns({"abs_path": F.concat_ws("/", "root", "source_path"), "score": F.round("score", 6), **{f"is_{k}": v for k, v in flags.items()}}).drop("keywords", "root")


def semantic_indexed(hits: DataFrame, points: DataFrame | None) -> DataFrame:
    """True with a semantic rank, else whether the point exists; null where the point table can't be asked."""
    if points is None:
        return hits.withColumn("semantic_indexed", F.when(F.col("semantic_rank").isNotNull(), True))
    known = points.select("point_id").distinct().withColumn("known", F.lit(True))
    rows = hits.withColumn("point_id", point_id(F.col("identity"))).join(known, "point_id", "left")
    return rows.withColumn("semantic_indexed", F.col("semantic_rank").isNotNull() | F.coalesce("known", F.lit(False))).drop("known", "point_id")


def recall(queries: DataFrame, lexical: DataFrame, semantic_hits: DataFrame | None, docs: DataFrame, k: int, lane: str = "hybrid", protect: bool = True, kind_prior: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, health). lane ``lexical`` ignores vectors; ``semantic`` is gated and doesn't fall back; ``hybrid`` falls
    back to the lexical lane for queries without semantic hits."""
    plan = query_features(queries, protect)
    none = lexical.limit(0).select(*KEY, "score")
    gated = gate(semantic_hits, docs) if semantic_hits is not None and lane != "lexical" else None
    kept = gated.filter("reason is null").select(*KEY, "score") if gated is not None else none
    words = lexical.select(*KEY, "score") if lane != "semantic" else none
    hits = fuse(words, kept, plan, k, docs if kind_prior and lane == "hybrid" else None)
    return hits, health(plan, hits, gated, docs, lane)


def health(queries: DataFrame, hits: DataFrame, gated: DataFrame | None, docs: DataFrame, lane: str) -> DataFrame:
    """Per query: status, semantic_on, freshness, stale reasons with counts, dropped keys, missing_kind, n_hits,
    has_signal (something is off)."""
    base = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id", "left").fillna(0, ["n_hits"])
    missing = docs.agg(F.count_if(~F.col("kind_explicit")).alias("missing_kind"))
    reasons = "map<string,bigint>"
    if gated is None:
        base = base.withColumns({"n_semantic": F.lit(0).cast("long"), "stale_dropped": F.array().cast("array<struct<identity:string,reason:string>>"), "stale_reasons": F.create_map().cast(reasons)})
    else:
        drops = gated.groupBy("query_id").agg(F.count("*").alias("n_semantic"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("identity", "reason")))).alias("stale_dropped"))
        counts = gated.filter("reason is not null").groupBy("query_id", "reason").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("stale_reasons"))
        base = base.join(drops, "query_id", "left").join(counts, "query_id", "left").fillna(0, ["n_semantic"])
        base = base.withColumns({"stale_dropped": F.coalesce("stale_dropped", F.array().cast("array<struct<identity:string,reason:string>>")), "stale_reasons": F.coalesce("stale_reasons", F.create_map().cast(reasons))})
    on = F.lit(lane != "lexical") & (F.col("n_semantic") > 0)
    stale = F.size("stale_dropped")
    rows = base.crossJoin(F.broadcast(missing))  # one row
    status = F.when(F.col("n_hits") == 0, "empty").when(F.lit(lane == "hybrid") & ~on, "degraded").otherwise("ok")
    return rows.select("query_id", status.alias("status"), on.alias("semantic_on"), F.when(stale > 0, "stale").otherwise("fresh").alias("freshness"), "stale_reasons", "stale_dropped", "missing_kind", "n_hits", ((stale > 0) | (F.col("missing_kind") > 0) | (status != "ok")).alias("has_signal"))


def plan_trace(queries: DataFrame, protect: bool = True) -> DataFrame:
    """What the planner decides for each query."""
    return query_features(queries, protect).select("query_id", "n_cjk", "n_identifiers", "n_code", "low_anchor", "strong_anchor", "w_lexical", "w_semantic", F.when(F.col("low_anchor"), DEPTH).alias("semantic_depth"))
