"""Queries on domains, identities, headers and compilation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embedding_text, prefixes
from ..functions.text import source_hash as source_hash_of
from ..operators import compile as compile_
from ..operators import conform, corpus
from .standins import DOCS_SQL, EMBED_SQL, HEADERS, NOTES_SQL, PATHS_SQL, docs, notes, paths, table


def domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = paths(spark, sf_dir)
    return found, corpus.discover_domains(corpus.index_directories(found))


def domain_tree(spark, sf_dir):
    return domains(spark, sf_dir)[1]


def nearest_domain(spark, sf_dir):
    return corpus.nearest_domain(*domains(spark, sf_dir))


def domain_prefixes(spark, sf_dir):
    return domains(spark, sf_dir)[1].select("source", "dir", F.explode(prefixes(F.col("domain"))).alias("prefix"))


def domain_capacity(spark, sf_dir):
    found, tree = domains(spark, sf_dir)
    return corpus.domain_capacity(corpus.locate_notes(found, tree, normalise=False), tree)


def empty_domains(spark, sf_dir):
    found, tree = domains(spark, sf_dir)
    located = corpus.locate_notes(found, tree, normalise=False)
    return corpus.empty_domains(tree, located.filter(~F.col("is_domain_index")))


def stray_notes(spark, sf_dir):
    return corpus.stray_notes(*domains(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    found, tree = domains(spark, sf_dir)
    return corpus.corpus_stats(corpus.locate_notes(found, tree, normalise=False), tree)


def duplicate_domains(spark, sf_dir):
    return corpus.duplicate_domains(domains(spark, sf_dir)[1])


def source_health(spark, sf_dir):
    found, tree = domains(spark, sf_dir)
    stray = corpus.stray_notes(found, tree).select("source", F.when(F.col("n_stray") > 6, "error").otherwise("warning").alias("severity"))
    return corpus.source_health(found, tree, stray)


def identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.identity(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("identity"))


def identity_collisions(spark, sf_dir):
    """Whole texts as slugs: equal after normalization and case folding."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.concat_ws(":", "source", "lang", F.coalesce("text", F.lit(""))).alias("identity"))
    return corpus.identity_collisions(rows)


def envelope_state(spark, sf_dir):
    return conform.with_envelope(notes(spark, sf_dir)).select("doc_id", "state", F.length("header").alias("header_chars"), F.length("body").alias("body_chars"))


def _parsed(spark, sf_dir):
    return conform.parse_headers(conform.with_envelope(notes(spark, sf_dir)))


def doc_diagnostics(spark, sf_dir):
    return conform.note_diagnostics(_parsed(spark, sf_dir)).select("source", "path", "code", "field")


def legacy_diagnostics(spark, sf_dir):
    return conform.legacy_diagnostics(conform.parse_headers(conform.with_envelope(notes(spark, sf_dir)), "v1")).select("source", "path", "code", "severity", "field")


def with_odd_fences(spark, sf_dir):
    """Notes of which every fourth begins with a byte order mark and a fence that ends in CRLF."""
    fence = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("content", r"\A---\n", "\ufeff---\r\n")).otherwise(F.col("content"))
    return notes(spark, sf_dir).withColumn("content", fence)


def migrate_headers(spark, sf_dir):
    return conform.strip_fields(with_odd_fences(spark, sf_dir)).select("doc_id", F.concat_ws(",", "removed").alias("removed"), F.sha2("new_content", 256).alias("content_sha256"))


def render_notes(spark, sf_dir):
    d = docs(spark, sf_dir)
    meta = F.struct("description", "keywords", "kind", F.array().cast("array<string>").alias("links"), F.array(F.lit("src/a b.py")).alias("code"), F.array().cast("array<string>").alias("assets"), F.lit(None).cast("string").alias("supersedes"), "status")
    return d.withColumn("meta", meta).select("doc_id", F.sha2(conform.render_note("meta", "body_text"), 256).alias("note_sha256"))


def slug_excess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", conform.slug_excess_words(F.regexp_replace(F.coalesce("text", F.lit("")), " ", "-")).alias("excess"))


def compiled_rows(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    bad = conform.note_diagnostics(parsed).select("source", "path").distinct().withColumn("bad", F.lit(True))
    return parsed.join(bad, ["source", "path"], "left").withColumns({"domain": F.col("lang"), "slug": F.col("doc_id").cast("string"), "identity": F.concat_ws(":", "source", "lang", "doc_id")})


def compile_docs(spark, sf_dir):
    good = compiled_rows(spark, sf_dir).filter("bad is null")
    return compile_.compile_notes(good).select("identity", "domain", "title", "description", F.array_join("keywords", ",").alias("keywords"), "kind", "kind_explicit", "source_path", "source_hash", F.sha2("body_text", 256).alias("body_sha256"), F.length("compiled_hash").alias("hash_chars"))


def compiled_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "compiled_hash")


def embedding_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(embedding_text(F.col("description"), F.col("keywords"), F.col("body_text")), 256).alias("text_hash"))


def source_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", source_hash_of(F.coalesce("text", F.lit(""))).alias("source_hash"))


def _report(spark, sf_dir):
    rows = compiled_rows(spark, sf_dir)
    facts = rows.select("source", "domain", F.col("bad").isNull().alias("compiled"), F.element_at("fields", "kind").isNotNull().alias("kind_explicit"), F.lit(None).cast("string").alias("kind_downgraded_from"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("error"))
    domains = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("domain")).distinct()
    return compile_.compile_report(facts.withColumn("kind_explicit", F.coalesce("kind_explicit", F.lit(False))), domains)


def compile_report(spark, sf_dir):
    return _report(spark, sf_dir)


def integrity(spark, sf_dir):
    return compile_.integrity_findings(_report(spark, sf_dir))


def missing_kind(spark, sf_dir):
    return compile_.missing_kind(docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (domain_tree, nearest_domain, domain_prefixes, domain_capacity, empty_domains, stray_notes, corpus_stats, duplicate_domains, source_health, identity, identity_collisions, envelope_state, doc_diagnostics, legacy_diagnostics, migrate_headers, render_notes, slug_excess, compile_docs, compiled_hashes, embedding_texts, source_hash, compile_report, integrity, missing_kind)}

_LISTED = "listed AS (SELECT source, domain, count(*) FILTER (path <> dir || '/INDEX.md') AS n_notes FROM near GROUP BY 1, 2)"
_STRAY = "stray AS (SELECT source, count(*) AS n_stray FROM files WHERE split_part(path, '/', -1) <> 'INDEX.md' AND (source, path) NOT IN (SELECT (source, path) FROM near) GROUP BY 1)"
_CODES = {"DESC": "KBV2-NOTE-EMPTY-FIELD", "TYPE": "KBV2-NOTE-WRONG-TYPE", "GONE": "KBV2-NOTE-REMOVED-FIELD"}
_EXPECTED = (
    (0, "KBV2-NOTE-FRONTMATTER-MISSING", None), (1, "KBV2-NOTE-FRONTMATTER-UNTERMINATED", None),
    (3, _CODES["DESC"], "description"), (3, "KBV2-NOTE-INVALID-KIND", "kind"), (3, "KBV2-NOTE-INVALID-STATUS", "status"), (3, "KBV2-NOTE-MISSING-FIELD", "keywords"),
    (4, _CODES["TYPE"], "keywords"), (4, _CODES["GONE"], "title"), (4, "KBV2-NOTE-UNKNOWN-FIELD", "foo"), (4, "KBV2-NOTE-MISSING-FIELD", "description"),
    (5, _CODES["DESC"], "keywords[1]"), (5, "KBV2-NOTE-FIELD-NOT-ALLOWED", "assets"),
)
_LEGACY = (
    (3, "V1-DESCRIPTION", "error", "description"), (3, "V1-KEYWORDS", "error", "keywords"), (3, "V1-KIND", "error", "kind"), (3, "V1-STATUS", "error", "status"),
    (4, "V1-DESCRIPTION", "error", "description"), (4, "V1-KEYWORDS", "error", "keywords"), (4, "V1-REMOVED", "error", "title"), (4, "V1-UNKNOWN", "warning", "foo"),
    (5, "V1-ASSETS-KIND", "warning", "assets"),
)


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


def _noted(header: str) -> str:
    """SQL of a note with a header, in the fences of ``with_odd_fences``."""
    lines = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in header.split("\n"))
    return f"CASE WHEN doc_id % 4 = 0 THEN chr(65279) || '---' || chr(13) ELSE '---' END || chr(10) || {lines} || '---' || chr(10) || chr(10) || body"


_ODD = "CASE WHEN doc_id % 4 = 0 AND doc_id % 6 > 0 THEN chr(65279) || '---' || chr(13) || substr(content, 4) ELSE content END"
_EVIDENCE = 'evidence: ["a", "b \\"c\\""]\n'
_VALID = "doc_id % 6 = 2"
ORACLE_SQL = {
    "domain_tree": f"WITH {PATHS_SQL} SELECT source, dir, domain FROM dom",
    "nearest_domain": f"WITH {PATHS_SQL} SELECT source, path, dir, domain FROM near",
    "domain_prefixes": f"WITH {PATHS_SQL} SELECT source, dir, array_to_string(s[1:i], '/') AS prefix FROM (SELECT source, dir, string_split(domain, '/') AS s, unnest(range(1, len(string_split(domain, '/')) + 1)) AS i FROM dom)",
    "domain_capacity": f"WITH {PATHS_SQL}, {_LISTED} SELECT source, domain, n_notes, n_notes > 10 AS over FROM listed",
    "empty_domains": f"WITH {PATHS_SQL}, {_LISTED} SELECT source, domain FROM listed WHERE n_notes = 0",
    "stray_notes": f"WITH {PATHS_SQL}, {_STRAY} SELECT * FROM stray",
    "corpus_stats": f"WITH {PATHS_SQL}, {_LISTED} SELECT count(DISTINCT source) AS n_sources, count(*) AS n_domains, sum(n_notes)::BIGINT AS n_notes FROM listed",
    "duplicate_domains": f"WITH {PATHS_SQL} SELECT source, 'KBV2-DOMAIN-DUPLICATE' AS code, 'error' AS severity, dir || '/INDEX.md' AS path, 'domain' AS field, 'domain collides after normalization and case folding' AS message FROM dom QUALIFY count(*) OVER (PARTITION BY source, lower(domain)) > 1",
    "source_health": f"WITH {PATHS_SQL}, {_STRAY}, n AS (SELECT source, count(*) AS n_domains FROM dom GROUP BY 1) SELECT s.source, coalesce(n_domains, 0) AS n_domains, CASE WHEN n_stray > 6 THEN 1 ELSE 0 END::BIGINT AS n_errors, coalesce(n_domains, 0) > 0 AND NOT coalesce(n_stray > 6, false) AS ok FROM (SELECT DISTINCT source FROM files) s LEFT JOIN n USING (source) LEFT JOIN stray USING (source)",
    "identity": "SELECT doc_id, source || ':' || lang || ':' || doc_id AS identity FROM documents",
    "identity_collisions": r"SELECT source, 'KBV2-IDENTITY-COLLISION' AS code, 'error' AS severity, doc_id::VARCHAR AS path, 'identity' AS field, 'note identity collides after normalization and case folding' AS message FROM documents QUALIFY count(*) OVER (PARTITION BY source, nfc_normalize(lower(lang || ':' || coalesce(text, '')))) > 1",
    "envelope_state": f"WITH {NOTES_SQL} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'unterminated' ELSE 'ok' END AS state, CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {len(h)}' for i, h in enumerate(HEADERS) if h)} END AS header_chars, CASE WHEN doc_id % 6 > 1 THEN length(body) + 1 END AS body_chars FROM notes",
    "doc_diagnostics": f"SELECT source, lang || '/' || doc_id || '.md' AS path, code, field FROM documents JOIN {_values(_EXPECTED)} v(m, code, field) ON doc_id % 6 = m",
    "legacy_diagnostics": f"SELECT source, lang || '/' || doc_id || '.md' AS path, code, severity, field FROM documents JOIN {_values(_LEGACY + ((5, 'V1-X', '', ''),))} v(m, code, severity, field) ON doc_id % 6 = m WHERE code <> 'V1-X'",
    "migrate_headers": f"WITH {NOTES_SQL} SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'status' WHEN 4 THEN 'title' ELSE '' END AS removed, sha256(CASE doc_id % 6 WHEN 3 THEN {_noted(HEADERS[3].replace('status: draft' + chr(10), ''))} WHEN 4 THEN {_noted(HEADERS[4].replace('title: t' + chr(10), ''))} ELSE {_ODD} END) AS content_sha256 FROM notes",
    "rewrite_headers": f"WITH {NOTES_SQL} SELECT doc_id, sha256(CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {_noted(h.replace('status: draft', 'status: derived') + ('' if i == 3 else 'status: derived' + chr(10)) + _EVIDENCE)}" for i, h in enumerate(HEADERS) if h) + " END) AS content_sha256 FROM notes WHERE doc_id % 6 > 1",
    "render_notes": f"""WITH {DOCS_SQL} SELECT doc_id, sha256('---' || chr(10) || 'description: "' || description || '"' || chr(10) || 'keywords: [' || replace(keywords, ' ', ', ') || ']' || chr(10) || 'kind: ' || kind || chr(10) || 'code: ["src/a b.py"]' || chr(10) || coalesce('status: ' || status || chr(10), '') || '---' || chr(10) || chr(10) || CASE WHEN body_text <> '' THEN body_text || chr(10) ELSE '' END) AS note_sha256 FROM docs""",
    "slug_excess": "SELECT doc_id, greatest(0, len(string_split(regexp_replace(trim(replace(coalesce(text, ''), ' ', '-')), '^adr-\\d+-', ''), '-')) - 6)::INT AS excess FROM documents",
    "compile_docs": rf"WITH {NOTES_SQL} SELECT source || ':' || lang || ':' || doc_id AS identity, lang AS domain, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE doc_id::VARCHAR END AS title, 'first' AS description, 'a,b' AS keywords, 'spec' AS kind, true AS kind_explicit, path AS source_path, sha256(regexp_replace(content, '\r\n?', chr(10), 'g')) AS source_hash, sha256(trim(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10))) AS body_sha256, 64 AS hash_chars FROM notes WHERE {_VALID}",
    "compiled_hashes": rf"WITH {DOCS_SQL} SELECT doc_id, sha256(json_object('schema', 'knowledge-doc-v2', 'identity', identity, 'source', source, 'domain', domain, 'domain_prefixes', [domain], 'title', title, 'description', description, 'keywords', [lang, 'k' || (doc_id % 3)], 'kind', kind, 'kind_explicit', kind_explicit, 'status', status, 'body_text', body_text, 'source_path', source_path, 'source_hash', source_hash, 'commit_time', NULL)::VARCHAR) AS compiled_hash FROM docs",
    "embedding_texts": f"WITH {DOCS_SQL} SELECT doc_id, sha256({EMBED_SQL}) AS text_hash FROM docs",
    "source_hash": r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS source_hash FROM documents",
    "compile_report": f"SELECT source, count(DISTINCT lang) AS n_domains, count(DISTINCT lang) - count(DISTINCT CASE WHEN {_VALID} THEN lang END) AS empty_domains, count(*) FILTER ({_VALID}) AS indexed, count(*) FILTER (NOT ({_VALID})) AS skipped, 0::BIGINT AS kind_missing, 0::BIGINT AS downgraded, 0::BIGINT AS n_errors FROM documents GROUP BY 1",
    "integrity": f"WITH r AS (SELECT source, count(*) FILTER ({_VALID}) AS indexed, count(*) FILTER (NOT ({_VALID})) AS skipped FROM documents GROUP BY 1) SELECT source, 'ZERO_DOC' AS code FROM r WHERE indexed = 0 UNION ALL SELECT source, 'DOMAIN_SKIP' FROM r WHERE skipped > 0",
    "missing_kind": "SELECT count(*) FILTER (doc_id % 3 = 0) AS missing_kind FROM documents",
}
