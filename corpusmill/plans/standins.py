"""The driver's tables as notes, documents, points and histories; and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_text, source_hash, title_of
from ..operators.compile import compiled_json
from ..operators.conform import KINDS
from ..schemas import DOC_COLUMNS, DOC_SCHEMA
from ..sources.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, path): pages as files, with indexes in every top directory and in those of some pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("w"), F.col("page_id") % 4).alias("source"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]+)", 1).alias("seg")).filter("seg <> ''")
    d = F.concat("seg", F.lit("/d"), F.col("page_id") % 5)
    e = F.concat(d, F.lit("/e"), F.col("page_id") % 3)
    file = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("loose/"), "page_id", F.lit(".md"))).otherwise(F.concat(e, F.lit("/"), "page_id", F.lit(".md")))
    index = lambda rows, dir_: rows.select("source", F.concat(dir_, F.lit("/INDEX.md")).alias("path"))
    found = index(p, F.col("seg")).union(index(p.filter("page_id % 5 % 2 = 0"), d)).union(index(p.filter("page_id % 2 = 0"), e)).distinct()
    return p.select("source", file.alias("path")).union(found)


PATHS_SQL = """
p AS (SELECT page_id, 'w' || (page_id % 4) AS source, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS seg FROM pages),
q AS (SELECT *, seg || '/d' || (page_id % 5) AS d, seg || '/d' || (page_id % 5) || '/e' || (page_id % 3) AS e FROM p WHERE seg <> ''),
idx AS (SELECT DISTINCT source, dir FROM (SELECT source, seg AS dir FROM q UNION ALL SELECT source, d FROM q WHERE page_id % 5 % 2 = 0 UNION ALL SELECT source, e FROM q WHERE page_id % 2 = 0)),
files AS (SELECT source, CASE WHEN page_id % 11 = 0 THEN 'loose/' || page_id || '.md' ELSE e || '/' || page_id || '.md' END AS path FROM q
          UNION ALL SELECT source, dir || '/INDEX.md' FROM idx),
dom AS (SELECT a.source, a.dir, string_agg(split_part(b.dir, '/', -1), '/' ORDER BY length(b.dir)) AS domain
        FROM idx a JOIN idx b ON a.source = b.source AND (a.dir = b.dir OR starts_with(a.dir, b.dir || '/')) GROUP BY 1, 2),
near AS (SELECT f.source, f.path, max_by(d.dir, length(d.dir)) AS dir, max_by(d.domain, length(d.dir)) AS domain
         FROM files f JOIN dom d ON f.source = d.source AND starts_with(f.path, d.dir || '/') GROUP BY 1, 2)"""

#: Header of a note by doc_id % 6; None: no envelope, False: one that never closes.
HEADERS = (
    None,
    False,
    "description: first\nkeywords: [a, b]\nkind: spec\n",
    'description: ""\nkind: odd\nstatus: draft\n',
    "keywords: x\ntitle: t\nfoo: 1\n",
    "description: 'it''s ok'\nkeywords: [a, ' ']\nassets: [repo:x]\n",
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes(doc_id, source, path, content): headers by doc_id, a heading on every second."""
    d = spread(table(spark, sf_dir, "documents"))
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Title "), "doc_id", F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    content = F.when(F.col("doc_id") % 6 == 0, body)
    for i, header in enumerate(HEADERS):
        if header is not None:
            text = F.concat(F.lit("---\n" + (f"{header}---\n\n" if header else "description: open\n")), body)
            content = content.when(F.col("doc_id") % 6 == i, text)
    return d.select("doc_id", "source", F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), content.alias("content"), "lang")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_BODY = "(CASE WHEN doc_id % 2 = 0 THEN '# Title ' || doc_id || chr(10) ELSE '' END || coalesce(text, ''))"
NOTES_SQL = (
    "notes AS (SELECT doc_id, source, lang, lang || '/' || doc_id || '.md' AS path, " + _BODY + " AS body, CASE doc_id % 6 WHEN 0 THEN " + _BODY + " "
    + " ".join(f"WHEN {i} THEN {_sql('---' + chr(10) + (h + '---' + chr(10) * 2 if h else 'description: open' + chr(10)))} || {_BODY}" for i, h in enumerate(HEADERS) if h is not None)
    + " END AS content FROM documents)"
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as compiled documents with doc_id: source, domain = lang, slug = doc_id; kind and status by doc_id."""
    d = spread(table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    body = body_text(F.col("text"))
    out = d.select(
        "doc_id",
        F.lit(DOC_SCHEMA).alias("schema"),
        F.concat_ws(":", "source", "lang", "doc_id").alias("identity"),
        "source",
        F.col("lang").alias("domain"),
        F.array("lang").alias("domain_prefixes"),
        title_of(body, F.substring_index("text", "\n", 1)).alias("title"),
        F.concat(F.lit("about "), "lang").alias("description"),
        F.array("lang", F.concat(F.lit("k"), F.col("doc_id") % 3)).alias("keywords"),
        kind.alias("kind"),
        (F.col("doc_id") % 3 != 0).alias("kind_explicit"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("frozen")).alias("status"),
        body.alias("body_text"),
        F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"),
        source_hash(F.col("text")).alias("source_hash"),
        F.lit(None).cast("string").alias("commit_time"),
    )
    return out.withColumn("compiled_hash", F.sha2(compiled_json(), 256)).select("doc_id", *DOC_COLUMNS)


_KINDS = "['" + "','".join(KINDS) + "']"
DOCS_SQL = f"""
docs AS (SELECT doc_id, source || ':' || lang || ':' || doc_id AS identity, source, lang AS domain, lang, split_part(coalesce(text, ''), chr(10), 1) AS title,
         'about ' || lang AS description, lang || ' k' || (doc_id % 3) AS keywords, {_KINDS}[doc_id % 7 + 1] AS kind, doc_id % 3 <> 0 AS kind_explicit,
         CASE WHEN doc_id % 5 = 0 THEN 'frozen' END AS status, trim(coalesce(text, ''), chr(10)) AS body_text, lang || '/' || doc_id || '.md' AS source_path,
         sha256(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS source_hash FROM documents)"""
EMBED_SQL = "concat_ws(chr(10) || chr(10), description, keywords, nullif(regexp_replace(body_text, '^\\s+|\\s+$', '', 'g'), ''))"
