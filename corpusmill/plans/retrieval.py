"""Queries on lexical and semantic retrieval, fusion and evaluation: benchmark texts against documents.

The gold set is all (item, document) pairs where the document holds the item's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.segment import UNIT
from ..llm.textbytes import slices
from ..operators import bounded, cells, evaluate, fusion, lexical, semantic
from ..sources.export import export_hits
from ..sources.storage import materialise, spread
from .standins import DOCS_SQL, docs, table

K = 10


def asked(spark, sf_dir) -> DataFrame:
    """Every benchmark text, with facets by its number."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    pick = lambda m, r, v: F.when(i % m == r, F.lit(v))
    return b.select(i.alias("query_id"), "text", F.lit(None).cast("string").alias("source"), pick(4, 0, "/en/").alias("domain"), pick(4, 1, "spec").alias("kind"), pick(4, 2, "K1").alias("tag"), pick(4, 3, "frozen").alias("status"))


def _fields(spark, sf_dir):
    return lexical.lexical_fields(docs(spark, sf_dir))


def postings(spark, sf_dir):
    """Size of each field's postings per source: terms, entries and occurrences."""
    return lexical.postings(_fields(spark, sf_dir)).groupBy("corpus", "field").agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_entries"), F.sum("tf").alias("n_tokens"))


def postings_rows(spark, sf_dir):
    return lexical.postings(_fields(spark, sf_dir)).select("field", "term", "identity", "tf")


def field_stats(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    return lexical.field_stats(fields, lexical.field_lengths(fields)).select("corpus", "field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def matched(spark, sf_dir, queries=None):
    """The query terms counted in all documents, once for every profile and cut."""
    d = docs(spark, sf_dir)
    fields = lexical.lexical_fields(d.withColumn("facets", bounded.facet_keys()), ["facets"])
    return bounded.match(asked(spark, sf_dir) if queries is None else queries, fields)


def bm25_topk(spark, sf_dir):
    """Ten best of all sources, each scored within its source."""
    return bounded.best(matched(spark, sf_dir), K, digits=6)


def bm25_per_source(spark, sf_dir):
    return bounded.best(matched(spark, sf_dir), 3, per_source=True, digits=6)


def bm25_global(spark, sf_dir):
    return bounded.best(matched(spark, sf_dir), K, "v2", digits=6)


def bm25_facets(spark, sf_dir):
    needs = asked(spark, sf_dir).withColumn("needs", bounded.facet_needs("domain", "kind", "status", "tag"))
    return bounded.best(matched(spark, sf_dir, needs), K, digits=6)


def query_features(spark, sf_dir):
    return fusion.plan_trace(asked(spark, sf_dir))


#: Stand-ins for 26 letters.
IDEOGRAPHS = "".join(chr(0x4E00 + i) for i in range(26))
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def cjk_tokens(spark, sf_dir):
    """Documents with ideographs for letters, cut by a lexicon of their own words of two to four letters (at most 26^2 +
    26^3 + 26^4): each token with its documents and occurrences."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.translate(F.lower(F.coalesce("text", F.lit(""))), LETTERS, IDEOGRAPHS).alias("text"))
    run = r"([\x{4E00}-\x{4E19}]+)"
    known = d.select(F.explode(F.regexp_extract_all("text", F.lit(run), 1)).alias("term")).filter("length(term) between 2 and 4")
    cut = segment.cutter(known.groupBy("term").agg(F.count("*").alias("freq")))
    words = segment.pieces(d.select("doc_id", segment.words(F.col("text")).alias("words")))
    tokens = words.select("doc_id", F.explode(cut(F.col("words"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tokens.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def vectors(spark, sf_dir):
    """The stated query set: every point whose id is divisible by 50."""
    return points(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def knn_topk(spark, sf_dir):
    return semantic.cosine_top(vectors(spark, sf_dir), points(spark, sf_dir), K, ["vec_id"]).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def knn_cells(spark, sf_dir):
    """``knn_topk`` by way of cells of points."""
    index = cells.build_index(points(spark, sf_dir).select("vec_id", "vector"), ["vec_id"])
    return cells.pruned_top(vectors(spark, sf_dir), index, K, ["vec_id"]).hits.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def knn_filtered(spark, sf_dir):
    return semantic.cosine_top(vectors(spark, sf_dir), points(spark, sf_dir).filter("label in (1, 3, 5)"), K, ["vec_id"]).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def knn_dedup(spark, sf_dir):
    """Best point of each label."""
    return semantic.cosine_top(vectors(spark, sf_dir), points(spark, sf_dir), K, ["label", "vec_id"], per_object="label").select("query_id", "label", "vec_id", "rank", F.round("score", 5).alias("score"))


#: What lanes and gates ask of a document beside its text.
FACTS = ("doc_id", "source", "identity", "kind", "kind_explicit", "source_hash", "compiled_hash")


def lanes(spark, sf_dir, gated=True):
    """(facts of the documents, lexical lane, other lane). Lexical: the per-source profile; the other lane: the global profile,
    with hashes as an index would hold them. Cut where a bounded search cuts: hits beyond these depths can't be fused. Where
    hits are gated, texts are hashed once and the facts written."""
    d, found = docs(spark, sf_dir).select(*FACTS), matched(spark, sf_dir)
    d = materialise(d, "facts") if gated else d
    a = bounded.best(found, fusion.DEPTH, "v1", digits=6).drop("rank")
    b = bounded.best(found, fusion.RAW_DEPTH, "v2", digits=6).drop("rank")
    n = F.col("doc_id")
    held = d.select(
        "source", "identity",
        F.when(n % 7 == 6, None).when(n % 7 == 1, "chunk").otherwise("whole").alias("unit_mode"),
        F.when(n % 7 == 6, None).when(n % 7 == 2, "").otherwise("t").alias("text_hash"),
        F.when(n % 7 == 3, "old").when(n % 7 == 5, None).otherwise(F.col("source_hash")).alias("source_hash"),
        F.when(n % 7 == 4, "old").otherwise(F.col("compiled_hash")).alias("compiled_hash"),
    )
    return d, a, b.join(held, ["source", "identity"])


def published(d):
    """Documents that are still there: every thirteenth is gone."""
    return d.filter("doc_id % 13 <> 0")


def stale_gate(spark, sf_dir):
    d, _, b = lanes(spark, sf_dir)
    return fusion.gate(b, published(d)).select("query_id", "identity", "reason")


def _fused(spark, sf_dir, prior):
    d, a, b = lanes(spark, sf_dir)
    kept = fusion.gate(b, published(d)).filter("reason is null")
    return fusion.fuse(a, kept, fusion.query_features(asked(spark, sf_dir)), K, d if prior else None)


def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, False).withColumn("score", F.round("score", 9))


def kind_prior(spark, sf_dir):
    return _fused(spark, sf_dir, True).withColumn("score", F.round("score", 9))


def recall_health(spark, sf_dir):
    d, a, b = lanes(spark, sf_dir)
    health = fusion.recall(asked(spark, sf_dir), a, b, published(d), K)[1]
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("stale_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return health.select("query_id", "status", "semantic_on", "freshness", reasons.alias("stale_reasons"), F.size("stale_dropped").alias("n_stale"), "missing_kind", "n_hits", "has_signal")


def export_ranked(spark, sf_dir):
    hits = bm25_topk(spark, sf_dir)
    return export_hits(hits, docs(spark, sf_dir)).select("query_id", "rank", "identity", F.sha2("text", 256).alias("text_sha256"), "n_chars", "truncated")


def _holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs joined to the short items that their texts hold, where no inner words can be keys: items go to the tasks in blocks
    of checked size, and each is searched for in a whole batch of texts at once."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("passage") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // semantic.QUERY_BYTES))
    out = docs.limit(0).withColumns({"item_id": F.lit(0).cast("long"), "passage": F.lit("")})
    for i in range(n_blocks):
        held = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).select("item_id", "passage").collect()]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                for item_id, passage in held:
                    hit = batch.filter(pc.match_substring(batch.column("text"), passage))
                    if hit.num_rows:
                        more = [pa.array([item_id] * hit.num_rows, pa.int64()), pa.array([passage] * hit.num_rows)]
                        yield pa.RecordBatch.from_arrays([*hit.columns, *more], [*batch.schema.names, "item_id", "passage"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields) + ", item_id long, passage string"
        out = out.unionByName(docs.mapInArrow(run, schema)) if held else out
    return out


def _gold(spark, sf_dir):
    """Found by an equality on three inner words of an item (from its second on) before the exact containment, so no
    pair is formed that doesn't share them; items of fewer than five words, which have no such key, are searched for in
    the texts themselves. Items without a word are no gold."""
    words = lambda text: F.split(text, r"\s+")
    zipped = lambda w: F.arrays_zip(w, F.slice(w, 2, 1 << 30), F.slice(w, 3, 1 << 30))
    grams = lambda w: F.array_distinct(F.transform(zipped(w), lambda z: F.concat_ws(" ", z["0"], z["1"], z["2"])))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("passage")).filter(F.trim("passage") != "")
    long = F.size(words(F.trim("passage"))) >= 5
    keyed = b.filter(long).withColumn("key", F.array_join(F.slice(words(F.ltrim("passage")), 2, 3), " "))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat_ws(":", "source", "lang", "doc_id").alias("identity"), "source", F.coalesce("text", F.lit("")).alias("text"))
    hit = d.withColumn("key", F.explode(grams(words(F.col("text"))))).join(keyed, "key").filter(F.contains("text", "passage")).drop("key")
    hit = hit.unionByName(_holding(d, b.filter(~long)))
    kind = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    return materialise(hit.select(F.col("item_id").alias("query_id"), F.col("identity").alias("gold_key"), "source", kind.alias("qtype"), F.concat(F.lit("s"), F.col("item_id") % 3).alias("_slice")), "gold")


def _ranks(gold, found):
    own = gold.select("query_id", "source").distinct()
    hits = found.join(own, ["query_id", "source"], "left_semi")
    return materialise(evaluate.gold_ranks(gold, hits), "gold-ranks")


def both_ranks(spark, sf_dir, profiles=("v1", "v2")):
    """Ranks of the gold under each profile, from one gold set and one table of matches."""
    gold, found = _gold(spark, sf_dir), matched(spark, sf_dir)
    return [_ranks(gold, bounded.best(found, K, p, per_source=True, digits=6)) for p in profiles]


def gold_metrics(spark, sf_dir):
    return evaluate.metrics(*both_ranks(spark, sf_dir, ["v1"]))


BY = ["qtype", "_slice", "source"]


def gold_slices(spark, sf_dir):
    return evaluate.slices(*both_ranks(spark, sf_dir, ["v1"]), BY)


def gates(spark, sf_dir):
    """Per-source profile against the global one as baseline."""
    return evaluate.lexical_gate(*(evaluate.slices(ranks, BY) for ranks in both_ranks(spark, sf_dir)))


def ab_verdict(spark, sf_dir):
    default, candidate = (evaluate.slices(ranks, BY) for ranks in both_ranks(spark, sf_dir))
    return evaluate.ab_verdict(candidate, default)


QUERIES = {f.__name__: f for f in (postings, postings_rows, field_stats, bm25_topk, bm25_per_source, bm25_global, bm25_facets, query_features, cjk_tokens, knn_topk, knn_cells, knn_filtered, knn_dedup, stale_gate, rrf_fusion, kind_prior, recall_health, export_ranked, gold_metrics, gold_slices, gates, ab_verdict)}

_RUNS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_TERMS = f"""
fields AS (SELECT doc_id, source, identity, unnest([{{'field': 'title', 'text': title}}, {{'field': 'body', 'text': description || ' ' || keywords || ' ' || body_text}}, {{'field': 'identity', 'text': identity}}, {{'field': 'source_path', 'text': source_path}}], recursive := true) FROM docs),
tok AS (SELECT source, identity, field, unnest({_RUNS.format('text')}) AS term FROM fields),
post AS (SELECT source, field, term, identity, count(*) AS tf FROM tok WHERE field IN ('identity', 'source_path') OR length(term) <= 40 GROUP BY ALL)"""
POSTINGS_SQL = DOCS_SQL + "," + _TERMS


def _bm25(name: str, corpus: str) -> str:
    """CTEs for scores of all query and document pairs; corpus is ``source`` or a constant."""
    return rf"""
{name}p AS (SELECT *, {corpus} AS corpus FROM post),
{name}n AS (SELECT {corpus} AS corpus, count(*) AS n FROM docs GROUP BY 1),
{name}l AS (SELECT corpus, field, identity, sum(tf) AS dl FROM {name}p GROUP BY ALL),
{name}a AS (SELECT corpus, field, sum(tf) / any_value(n)::DOUBLE AS avgdl, any_value(n) AS n FROM {name}p JOIN {name}n USING (corpus) GROUP BY ALL),
{name}d AS (SELECT corpus, field, term, count(*) AS df FROM {name}p GROUP BY ALL),
{name} AS (SELECT query_id, source, identity, round(sum(q.qn * CASE field WHEN 'title' THEN 5.0 WHEN 'body' THEN 1.0 ELSE 2.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))::DOUBLE, 6) AS score
  FROM {name}p JOIN q USING (term) JOIN {name}d USING (corpus, field, term) JOIN {name}a USING (corpus, field) JOIN {name}l USING (corpus, field, identity)
  WHERE field IN ('identity', 'source_path') OR length(term) <= 40 GROUP BY 1, 2, 3 HAVING score > 0)"""


_Q = rf"q AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_RUNS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2)"
V1_SQL = f"WITH {POSTINGS_SQL}, {_Q}, {_bm25('v1', 'source')}"
_BOTH = f"{V1_SQL}, {_bm25('v2', chr(39) + '*' + chr(39))}"
_ORDER = "ORDER BY score DESC, source, identity"


def search_sql(scored: str, k: int) -> str:
    return f"SELECT query_id, source, identity, score, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM (SELECT * FROM {scored} QUALIFY row_number() OVER (PARTITION BY query_id, source {_ORDER}) <= {k}) QUALIFY rank <= {k}"


def _knn(where: str, extra: str = "") -> str:
    return f"SELECT q.vec_id AS query_id, p.label, p.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0 {where}{extra}"


LANES_SQL = f"""{_BOTH},
la AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY query_id {_ORDER}) <= {fusion.DEPTH}),
sb AS (SELECT v2.*, split_part(identity, ':', 3)::BIGINT AS doc_id FROM v2 QUALIFY row_number() OVER (PARTITION BY query_id {_ORDER}) <= {fusion.RAW_DEPTH}),
gated AS (SELECT *, CASE WHEN doc_id % 7 = 6 THEN NULL WHEN doc_id % 13 = 0 THEN 'compiled_doc_missing' WHEN doc_id % 7 = 1 THEN 'embedding_unit_mismatch'
   WHEN doc_id % 7 = 2 THEN 'text_hash_missing' WHEN doc_id % 7 = 3 THEN 'source_hash_mismatch' WHEN doc_id % 7 = 4 THEN 'compiled_hash_mismatch' END AS reason FROM sb),
ra AS (SELECT query_id, source, identity, row_number() OVER (PARTITION BY query_id {_ORDER}) AS lexical_rank FROM la),
rb AS (SELECT query_id, source, identity, row_number() OVER (PARTITION BY query_id {_ORDER}) AS semantic_rank FROM gated WHERE reason IS NULL QUALIFY semantic_rank <= {fusion.DEPTH}),
runs AS (SELECT item_id AS query_id, text, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_:-]*'), lambda t: regexp_matches(t, '[0-9_:-]') OR (regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]')) OR (regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]') AND length(t) >= 2)) AS code FROM benchmark),
w AS (SELECT query_id, CASE WHEN len(code) >= 2 THEN 2.0 ELSE 1.0 END AS wl FROM runs)"""


def _fuse(prior: str) -> str:
    return f"""{LANES_SQL}, f AS (SELECT query_id, source, identity, round((coalesce(wl / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0){prior})::DOUBLE, 9) AS score,
      coalesce(wl::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0){prior} AS raw, lexical_rank, semantic_rank
      FROM ra FULL JOIN rb USING (query_id, source, identity) JOIN w USING (query_id) JOIN docs USING (source, identity))
    SELECT query_id, source, identity, score, lexical_rank, semantic_rank, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, source, identity) AS rank FROM f QUALIFY rank <= {K}"""


TIER_SQL = " + 1.0::DOUBLE / (60 + CASE kind WHEN 'spec' THEN 1 WHEN 'reference' THEN 1 WHEN 'runbook' THEN 1 WHEN 'decision' THEN 2 WHEN 'index' THEN 2 WHEN 'research' THEN 3 ELSE 4 END)"
_GOLD = r"gold AS (SELECT item_id AS query_id, source || ':' || lang || ':' || doc_id AS gold_key, source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS qtype, 's' || (item_id % 3) AS _slice FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND trim(b.text) <> '')"
_METRICS = "count(*) AS n, count(*) FILTER (rank = 0) AS no_hit, " + ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 4) AS gold_at_{k}" for k in evaluate.CUTS) + ", round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr"


def _ranks_sql(name: str, lane: str) -> str:
    return f"{name} AS (SELECT g.*, coalesce(r.rank, 0) AS rank FROM gold g LEFT JOIN (SELECT query_id, identity AS gold_key, row_number() OVER (PARTITION BY query_id, source {_ORDER}) AS rank FROM {lane} QUALIFY rank <= {K}) r USING (query_id, gold_key))"


def _slices_sql(name: str, ranks: str) -> str:
    return f"{name} AS (SELECT CASE WHEN grouping(qtype) = 0 THEN 'qtype:' || qtype WHEN grouping(_slice) = 0 THEN '_slice:' || _slice WHEN grouping(source) = 0 THEN 'source:' || source ELSE 'overall' END AS slice, {_METRICS} FROM {ranks} GROUP BY GROUPING SETS ((), (qtype), (_slice), (source)))"


EVAL_SQL = f"{_BOTH}, {_GOLD}, {_ranks_sql('r1', 'v1')}, {_ranks_sql('r2', 'v2')}, {_slices_sql('s1', 'r1')}, {_slices_sql('s2', 'r2')}"
_FACET = "CASE query_id % 4 WHEN 0 THEN domain = 'en' WHEN 1 THEN kind = 'spec' WHEN 2 THEN doc_id % 3 = 1 ELSE coalesce(status, '') = 'frozen' END"
ORACLE_SQL = {
    "postings": f"WITH {POSTINGS_SQL} SELECT source AS corpus, field, count(DISTINCT term) AS n_terms, count(*) AS n_entries, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY 1, 2",
    "postings_rows": f"WITH {POSTINGS_SQL} SELECT field, term, identity, tf FROM post",
    "field_stats": f"WITH {POSTINGS_SQL}, n AS (SELECT source, count(*) AS n FROM docs GROUP BY 1) SELECT source AS corpus, field, any_value(n) AS n_docs, round(sum(tf) / any_value(n)::DOUBLE, 6) AS avgdl FROM post JOIN n USING (source) GROUP BY 1, 2",
    "bm25_topk": f"{V1_SQL} {search_sql('v1', K)}",
    "bm25_per_source": f"{V1_SQL} SELECT query_id, source, identity, score, row_number() OVER (PARTITION BY query_id, source {_ORDER}) AS rank FROM v1 QUALIFY rank <= 3",
    "bm25_global": f"{_BOTH} SELECT query_id, source, identity, score, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM v2 QUALIFY rank <= {K}",
    "bm25_facets": f"{V1_SQL}, kept AS (SELECT v1.* FROM v1 JOIN docs USING (source, identity) WHERE {_FACET}) {search_sql('kept', K)}",
    "query_features": r"SELECT item_id AS query_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]'))::INT AS n_cjk, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_:-]*'))::INT AS n_identifiers, len(code)::INT AS n_code, false AS low_anchor, len(code) >= 2 AS strong_anchor, CASE WHEN len(code) >= 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w_lexical, 1.0::DOUBLE AS w_semantic, NULL::INT AS semantic_depth FROM (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_:-]*'), lambda t: regexp_matches(t, '[0-9_:-]') OR (regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]')) OR (regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]') AND length(t) >= 2)) AS code FROM benchmark)",
    "cjk_tokens": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{LETTERS}', '{IDEOGRAPHS}'), '[\p{{L}}\p{{N}}]+')) AS w FROM documents),
        parts AS MATERIALIZED (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(w, '[\x{{4E00}}-\x{{4E19}}]+|[^\x{{4E00}}-\x{{4E19}}]+')) AS w FROM t) GROUP BY ALL),
        runs AS MATERIALIZED (SELECT w, sum(c) AS c FROM parts WHERE w >= '{IDEOGRAPHS[0]}' AND w < chr({0x4E1A}) GROUP BY w),
        whole AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{LETTERS}', '{IDEOGRAPHS}'), '[\x{{4E00}}-\x{{4E19}}]+')) AS w FROM documents),
        f AS (SELECT w AS term, count(*) AS n FROM whole WHERE length(w) BETWEEN 2 AND 4 GROUP BY 1),
        lex AS MATERIALIZED (SELECT term, floor({UNIT} * ln((SELECT sum(n) FROM f) / n) + 0.5)::BIGINT AS cost FROM f),
        one AS (SELECT floor({UNIT} * ln((SELECT sum(n) FROM f)) + 0.5)::BIGINT AS cost),
        dp AS (SELECT w, length(w) AS i, [0, 9e15::BIGINT, 9e15::BIGINT, 9e15::BIGINT] AS c, []::BIGINT[] AS lens FROM runs
               UNION ALL
               SELECT w, i - 1, [m] || c[1:3], [CASE m WHEN k4 THEN 4 WHEN k3 THEN 3 WHEN k2 THEN 2 ELSE 1 END] || lens
               FROM (SELECT *, least(k1, k2, k3, k4) AS m FROM (SELECT w, i, c, lens, one.cost + c[1] AS k1, coalesce(l2.cost + c[2], 9e15::BIGINT) AS k2, coalesce(l3.cost + c[3], 9e15::BIGINT) AS k3, coalesce(l4.cost + c[4], 9e15::BIGINT) AS k4
                     FROM dp LEFT JOIN lex l2 ON l2.term = substr(w, i, 2) LEFT JOIN lex l3 ON l3.term = substr(w, i, 3) LEFT JOIN lex l4 ON l4.term = substr(w, i, 4), one WHERE i > 0))),
        walk AS (SELECT w, lens, 1 AS p, NULL::VARCHAR AS word FROM dp WHERE i = 0
                 UNION ALL
                 SELECT w, lens, (p + lens[p])::INTEGER, substr(w, p, lens[p]) FROM walk WHERE p <= length(w)),
        words AS MATERIALIZED (SELECT w, word FROM walk WHERE word IS NOT NULL),
        grams AS (SELECT w, word AS term FROM words UNION ALL
                  SELECT w, substr(word, i, n) FROM (SELECT w, word, n, unnest(range(1, length(word) - n + 2)) AS i FROM words, (SELECT unnest([2, 3]) AS n) WHERE length(word) > n) SEMI JOIN lex ON lex.term = substr(word, i, n)),
        tok AS (SELECT doc_id, term, c FROM parts JOIN grams USING (w) UNION ALL
                SELECT doc_id, w, c FROM parts ANTI JOIN runs USING (w) WHERE length(w) <= 40)
        SELECT term, count(DISTINCT doc_id) AS df, sum(c)::BIGINT AS tf FROM tok GROUP BY term""",
    "knn_topk": f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 5) AS score FROM ({_knn('')}) QUALIFY rank <= {K}",
    "knn_cells": f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 5) AS score FROM ({_knn('')}) QUALIFY rank <= {K}",
    "knn_filtered": f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 5) AS score FROM ({_knn('AND p.label IN (1, 3, 5)')}) QUALIFY rank <= {K}",
    "knn_dedup": f"SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label, vec_id) AS rank, round(s, 5) AS score FROM (SELECT * FROM ({_knn('')}) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, vec_id) = 1) QUALIFY rank <= {K}",
    "stale_gate": f"{LANES_SQL} SELECT query_id, identity, reason FROM gated",
    "rrf_fusion": _fuse(""),
    "kind_prior": _fuse(TIER_SQL),
    "recall_health": f"{LANES_SQL}, hits AS (SELECT query_id, least(count(*), {K}) AS n_hits FROM ra FULL JOIN rb USING (query_id, source, identity) GROUP BY 1), reasons AS (SELECT query_id, string_agg(reason || '=' || c, ',' ORDER BY reason) AS stale_reasons, sum(c) AS n_stale FROM (SELECT query_id, reason, count(*) AS c FROM gated WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT item_id AS query_id, CASE WHEN coalesce(n_hits, 0) = 0 THEN 'empty' ELSE 'ok' END AS status, coalesce(n_hits, 0) > 0 AS semantic_on, CASE WHEN n_stale > 0 THEN 'stale' ELSE 'fresh' END AS freshness, coalesce(stale_reasons, '') AS stale_reasons, coalesce(n_stale, 0)::INT AS n_stale, (SELECT count(*) FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 3 = 0) AS missing_kind, coalesce(n_hits, 0)::BIGINT AS n_hits, true AS has_signal FROM benchmark LEFT JOIN hits ON item_id = hits.query_id LEFT JOIN reasons ON item_id = reasons.query_id",
    "export_ranked": f"{V1_SQL}, h AS ({search_sql('v1', K)}), t AS (SELECT query_id, rank, identity, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), trim(description), nullif(trim(body_text), '')) AS text FROM h JOIN docs USING (source, identity)) SELECT query_id, rank, identity, sha256(text) AS text_sha256, length(text)::INT AS n_chars, false AS truncated FROM t",
    "gold_metrics": f"{EVAL_SQL} SELECT {_METRICS} FROM r1",
    "gold_slices": f"{EVAL_SQL} SELECT * FROM s1",
    "gates": f"{EVAL_SQL} SELECT s2.slice, s1.gold_at_10 AS value, s2.gold_at_10 AS base, coalesce(s1.gold_at_10 >= s2.gold_at_10 - 0.01, false) AS ok, s2.gold_at_10 = 0 AS rebaseline FROM s2 LEFT JOIN s1 USING (slice)",
    "ab_verdict": f"{EVAL_SQL}, d AS (SELECT unnest([round(s2.gold_at_10 - s1.gold_at_10, 4), round(s2.gold_at_5 - s1.gold_at_5, 4), round(s2.mrr - s1.mrr, 4)]) AS delta FROM s2 JOIN s1 USING (slice)) SELECT count(*) FILTER (delta < -0.01) AS regressed, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < -0.01) = 0 AND count(*) FILTER (delta > 0) > 0 AS flip_on FROM d",
}
