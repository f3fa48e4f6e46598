"""Domain tree and identities of notes: discovery, nearest domains, validity, collisions, coverage.

Directories are rows; ancestors are exploded and joined back, so nothing recurses. ``notes`` has (source, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ancestors, directory, fold, nfc, stem
from .diagnostics import diagnostic

INDEX = "INDEX.md"


def index_directories(paths: DataFrame) -> DataFrame:
    """(source, dir) of directories with an exact INDEX.md; the root has no domain."""
    index = paths.filter(F.substring_index("path", "/", -1) == INDEX)
    return index.select("source", directory(F.col("path")).alias("dir")).filter("dir <> ''").distinct()


def discover_domains(index_dirs: DataFrame) -> DataFrame:
    """(source, dir, domain): a domain is the path of names of those ancestors only that own an index."""
    steps = index_dirs.select("source", F.col("dir").alias("owner"), F.explode(ancestors(F.col("dir"))).alias("dir"))
    found = steps.join(index_dirs, ["source", "dir"])
    part = F.struct(F.length("dir").alias("depth"), F.substring_index("dir", "/", -1).alias("name"))
    chain = found.groupBy("source", F.col("owner").alias("dir")).agg(F.array_sort(F.collect_list(part)).alias("chain"))
    return chain.select("source", "dir", F.array_join(F.transform("chain", lambda c: c["name"]), "/").alias("domain"))


def nearest_domain(notes: DataFrame, domains: DataFrame) -> DataFrame:
    """Notes with (dir, domain) of the deepest domain above them; notes outside every domain are dropped."""
    up = notes.withColumn("__up", F.explode(ancestors(directory(F.col("path")))))
    met = up.join(domains.select("source", F.col("dir").alias("__up"), F.col("domain").alias("__domain")), ["source", "__up"])
    best = F.max_by(F.struct(F.col("__up").alias("dir"), F.col("__domain").alias("domain")), F.length("__up"))
    return met.groupBy(*notes.columns).agg(best.alias("b")).select(*notes.columns, "b.dir", "b.domain")


def identity(source: Column, domain: Column, slug: Column) -> Column:
    """``source:domain:slug`` with the slug in NFC."""
    return F.concat_ws(":", source, domain, nfc(slug))


def locate_notes(notes: DataFrame, domains: DataFrame, normalise: bool = True) -> DataFrame:
    """Notes with dir, domain, slug, identity and is_domain_index."""
    near = nearest_domain(notes, domains).withColumn("slug", stem(F.col("path")))
    name = identity(F.col("source"), F.col("domain"), F.col("slug")) if normalise else F.concat_ws(":", "source", "domain", "slug")
    return near.withColumns({"identity": name, "is_domain_index": F.col("path") == F.concat_ws("/", "dir", F.lit(INDEX))})


def legacy_notes(notes: DataFrame) -> DataFrame:
    """Notes of legacy sources: all in domain ``legacy``, the slug is the path without its suffix."""
    slug = F.regexp_replace("path", r"\.md\z", "")
    return notes.select("*", F.lit("").alias("dir"), F.lit("legacy").alias("domain"), slug.alias("slug"), F.concat_ws(":", "source", F.lit("legacy"), slug).alias("identity"), F.lit(False).alias("is_domain_index"))


def name_violations(located: DataFrame) -> DataFrame:
    """Diagnostics for invalid source names, domain segments and slugs."""
    bad_segment = F.exists(F.split("domain", "/"), lambda s: ~valid_segment(s))
    rules = F.array(
        diagnostic("INVALID-SOURCE", "source", "source name is not valid", ~F.col("source").rlike(r"^[a-z0-9][a-z0-9_-]*$")),
        diagnostic("INVALID-DOMAIN", "domain", "domain has an invalid segment", bad_segment),
        diagnostic("INVALID-SLUG", "slug", "slug is not valid", ~valid_segment(F.col("slug"))),
    )
    return located.select("source", "path", F.inline(F.filter(rules, lambda d: d["code"].isNotNull()))).select("source", "code", "severity", "path", "field", "message")


def valid_segment(name: Column) -> Column:
    """Neither empty, ``.`` nor ``..``, without separators, colons, control characters or outer space."""
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/:\\\x00-\x1F\x7F]") & (F.trim(name) == name)


def collisions(rows: DataFrame, key: Column, within: list[str], code: str, field: str, message: str, path: str = "path") -> DataFrame:
    """One diagnostic per member of a group of equal keys."""
    n = F.count("*").over(Window.partitionBy(*within, "__key"))
    hit = rows.withColumn("__key", key).withColumn("__n", n).filter("__n > 1")
    return hit.select("source", F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col(path).alias("path"), F.lit(field).alias("field"), F.lit(message).alias("message"))


def identity_collisions(located: DataFrame) -> DataFrame:
    return collisions(located, fold(F.col("identity")), ["source"], "KBV2-IDENTITY-COLLISION", "identity", "note identity collides after normalization and case folding")


def duplicate_domains(domains: DataFrame) -> DataFrame:
    return collisions(domains.withColumn("path", F.concat_ws("/", "dir", F.lit(INDEX))), fold(F.col("domain")), ["source"], "KBV2-DOMAIN-DUPLICATE", "domain", "domain collides after normalization and case folding")


def duplicate_domains_v1(domains: DataFrame) -> DataFrame:
    """(source, domain, dirs) of exactly equal domains."""
    return domains.groupBy("source", "domain").agg(F.sort_array(F.collect_list("dir")).alias("dirs")).filter(F.size("dirs") >= 2)


def index_kind_violations(located: DataFrame) -> DataFrame:
    """Domain indexes whose kind isn't ``index``; located has a column ``kind``."""
    hit = located.filter(F.col("is_domain_index") & ~F.col("kind").eqNullSafe(F.lit("index")))
    return hit.select("source", F.lit("KBV2-INDEX-KIND").alias("code"), F.lit("error").alias("severity"), "path", F.lit("kind").alias("field"), F.lit("domain index must be of kind index").alias("message"))


def domain_listing(located: DataFrame, domains: DataFrame) -> DataFrame:
    """(source, domain, n_notes) with zero for domains without notes other than their index."""
    counts = located.filter(~F.col("is_domain_index")).groupBy("source", "domain").agg(F.count("*").alias("n"))
    return domains.select("source", "domain").distinct().join(counts, ["source", "domain"], "left").select("source", "domain", F.coalesce("n", F.lit(0)).alias("n_notes"))


def corpus_stats(located: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: n_sources, n_domains, n_notes (without indexes)."""
    listed = domain_listing(located, domains)
    return listed.agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_domains"), F.coalesce(F.sum("n_notes"), F.lit(0)).alias("n_notes"))


def domain_capacity(located: DataFrame, domains: DataFrame, most: int = 10, exempt: str = "decisions") -> DataFrame:
    """(source, domain, n_notes, over): domains with more notes than ``most``; a last segment ``exempt`` never is."""
    listed = domain_listing(located, domains)
    over = (F.col("n_notes") > most) & (F.substring_index("domain", "/", -1) != exempt)
    return listed.withColumn("over", over)


def empty_domains(domains: DataFrame, compiled: DataFrame) -> DataFrame:
    """Discovered domains without compiled notes."""
    return domains.select("source", "domain").distinct().join(compiled.select("source", "domain").distinct(), ["source", "domain"], "left_anti")


def source_health(sources: DataFrame, domains: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(source, n_domains, n_errors, ok): a source is healthy with at least one domain and no error."""
    n = domains.groupBy("source").agg(F.count("*").alias("n_domains"))
    e = diagnostics.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("n_errors"))
    joined = sources.select("source").distinct().join(n, "source", "left").join(e, "source", "left").fillna(0, ["n_domains", "n_errors"])
    return joined.withColumn("ok", (F.col("n_domains") > 0) & (F.col("n_errors") == 0))


def stray_notes(notes: DataFrame, domains: DataFrame) -> DataFrame:
    """(source, n_stray): Markdown files outside every domain, indexes excluded."""
    plain = notes.filter(F.substring_index("path", "/", -1) != INDEX).select("source", "path")
    inside = nearest_domain(plain, domains).select("source", "path")
    return plain.join(inside, ["source", "path"], "left_anti").groupBy("source").agg(F.count("*").alias("n_stray"))
