"""Compilation of notes to documents: one select over located, parsed notes, and the reports about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_text, fold, prefixes, sha256_hex, source_hash, stem, title_of
from ..schemas import DOC_COLUMNS, DOC_SCHEMA
from .conform import KINDS

NO_STRINGS = "array<string>"


def items(value: Column) -> Column:
    return F.coalesce(value["items"], F.array().cast(NO_STRINGS))


def clean_list(value: Column) -> Column:
    """v1: trimmed non-empty items; a scalar is a list of one."""
    many = F.when(value["type"] == "list", items(value)).when(value["type"] == "scalar", F.array(value["scalar"])).otherwise(F.array().cast(NO_STRINGS))
    return F.filter(F.transform(many, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def compiled_json(columns: list[str] | None = None) -> Column:
    """The 15 hashed fields in fixed order as compact JSON, nulls written."""
    names = columns or [c for c in DOC_COLUMNS if c != "compiled_hash"]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def compile_notes(located: DataFrame, commits: DataFrame | None = None, contract: str = "v2") -> DataFrame:
    """Documents of valid notes(source, path, content, body, fields, domain, slug, identity).

    v1 folds keywords and downgrades unknown kinds (kept in ``kind_downgraded_from``); v2 takes both verbatim."""
    f = lambda k: F.element_at("fields", k)
    raw_kind = f("kind")["scalar"]
    known = raw_kind.isin(*KINDS)
    kind = F.when(known, raw_kind).otherwise("note") if contract == "v1" else F.coalesce(raw_kind, F.lit("note"))
    keywords = F.transform(clean_list(f("keywords")), F.lower) if contract == "v1" else items(f("keywords"))
    rows = located
    if commits is not None:
        latest = commits.groupBy("source", "path").agg(F.max("commit_time").alias("commit_time"))
        rows = rows.join(latest, ["source", "path"], "left")
    else:
        rows = rows.withColumn("commit_time", F.lit(None).cast("string"))
    body = body_text(F.col("body"))
    out = rows.select(
        F.lit(DOC_SCHEMA if contract == "v2" else "kb-note-v1").alias("schema"),
        "identity",
        "source",
        "domain",
        prefixes(F.col("domain")).alias("domain_prefixes"),
        title_of(body, stem(F.col("path"))).alias("title"),
        F.coalesce(f("description")["scalar"], F.lit("")).alias("description"),
        keywords.alias("keywords"),
        kind.alias("kind"),
        (known if contract == "v1" else raw_kind.isNotNull()).alias("kind_explicit"),
        f("status")["scalar"].alias("status"),
        body.alias("body_text"),
        F.col("path").alias("source_path"),
        source_hash(F.col("content")).alias("source_hash"),
        "commit_time",
        F.when(raw_kind.isNotNull() & ~known, raw_kind).alias("kind_downgraded_from"),
    )
    out = out.withColumn("kind_explicit", F.coalesce("kind_explicit", F.lit(False)))
    hashed = out.withColumn("compiled_hash", sha256_hex(compiled_json()))
    return hashed.select(*DOC_COLUMNS, *(["kind_downgraded_from"] if contract == "v1" else []))


def fold_keywords(docs: DataFrame) -> DataFrame:
    """Keywords in full case folding, for both sides of the tag facet."""
    flat = docs.select("identity", F.posexplode_outer("keywords").alias("i", "k")).withColumn("k", fold(F.col("k")))
    folded = flat.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("i", "k")))), lambda x: x["k"]).alias("tags"))
    return docs.join(folded, "identity", "left")


def compile_legacy(notes: DataFrame, warning: str = "Legacy source, not verified.") -> DataFrame:
    """Legacy notes: a warning before description and body, and the marks legacy, raw and unverified as keywords."""
    f = lambda k: F.element_at("fields", k)
    body = body_text(F.coalesce("body", F.col("content")))
    out = notes.select(
        F.lit("kb-note-v1").alias("schema"), "identity", "source", "domain", prefixes(F.col("domain")).alias("domain_prefixes"),
        title_of(body, stem(F.col("path"))).alias("title"),
        F.concat_ws(" ", F.lit(warning), f("description")["scalar"]).alias("description"),
        F.array_distinct(F.concat(clean_list(f("keywords")), F.array(*map(F.lit, ("legacy", "raw", "unverified"))))).alias("keywords"),
        F.lit("note").alias("kind"), F.lit(False).alias("kind_explicit"), F.lit(None).cast("string").alias("status"),
        F.concat_ws("\n\n", F.lit(f"> {warning}"), F.when(body != "", body)).alias("body_text"),
        F.col("path").alias("source_path"), source_hash(F.col("content")).alias("source_hash"), F.lit(None).cast("string").alias("commit_time"),
    )
    return out.withColumn("compiled_hash", sha256_hex(compiled_json())).select(*DOC_COLUMNS)


def duplicate_identities(docs: DataFrame) -> DataFrame:
    """(source, identity, n) of identities that stand more than once; a snapshot needs none."""
    return docs.groupBy("source", "identity").agg(F.count("*").alias("n")).filter("n > 1")


def compile_report(notes: DataFrame, domains: DataFrame) -> DataFrame:
    """Per source of notes(source, domain, compiled boolean, kind_explicit, kind_downgraded_from, status, error):
    indexed, skipped, kind_missing, downgraded, n_domains, empty_domains, n_errors."""
    ok = F.col("compiled")
    per = notes.groupBy("source").agg(
        F.count_if(ok).alias("indexed"),
        F.count_if(~ok).alias("skipped"),
        F.count_if(ok & ~F.col("kind_explicit") & F.col("status").isNull()).alias("kind_missing"),
        F.count_if(ok & F.col("kind_downgraded_from").isNotNull()).alias("downgraded"),
        F.count_if(F.coalesce("error", F.lit(False))).alias("n_errors"),
    )
    used = notes.filter(ok).select("source", "domain").distinct().withColumn("used", F.lit(1))
    found = domains.select("source", "domain").distinct().join(used, ["source", "domain"], "left")
    tree = found.groupBy("source").agg(F.count("*").alias("n_domains"), F.count_if(F.col("used").isNull()).alias("empty_domains"))
    return tree.join(per, "source", "full").fillna(0)


def integrity_findings(report: DataFrame) -> DataFrame:
    """(source, code): ZERO_DOC where domains exist and nothing is indexed, DOMAIN_SKIP where notes were skipped;
    none for sources with hard errors."""
    sound = report.filter("n_errors = 0")
    zero = sound.filter("n_domains > 0 and indexed = 0").select("source", F.lit("ZERO_DOC").alias("code"))
    return zero.unionByName(sound.filter("skipped > 0").select("source", F.lit("DOMAIN_SKIP").alias("code")))


def missing_kind(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(~F.col("kind_explicit")).alias("missing_kind"))
