"""References, content and catalogs: every check explodes what a note points at and joins it to what is there."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import nfc, prefixes, stem
from .conform import ASSET_PREFIXES, asset_prefix

STRINGS = "array<string>"
#: The markers of a generated region; the messages of findings below that name links, code, assets, indexes.
START, END = "<!-- generated-index:start -->", "<!-- generated-index:end -->"
REUSE = 3


def _rows(df: DataFrame, code: str, severity: str, field: str | None, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return df.select("source", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", F.lit(field).cast("string").alias("field"), message.alias("message"))


def link_target(link: Column, source: Column, domain: Column) -> Column:
    """A three-part value is an identity, anything else a slug of the note's own domain."""
    return F.when(F.size(F.split(link, ":")) == 3, link).otherwise(F.concat_ws(":", source, domain, nfc(link)))


def broken_links(notes: DataFrame) -> DataFrame:
    """notes(source, path, domain, identity, status, links): unresolved targets; frozen notes are exempt."""
    live = notes.filter(~F.coalesce(F.col("status") == "frozen", F.lit(False)))
    links = live.select("source", "path", "domain", F.explode("links").alias("link")).withColumn("target", link_target(F.col("link"), F.col("source"), F.col("domain")))
    known = notes.select("source", F.col("identity").alias("target")).distinct()
    return _rows(links.join(known, ["source", "target"], "left_anti"), "KBV2-LINK-BROKEN", "error", "links", F.concat(F.lit("link target does not resolve: "), "target"))


def broken_links_v1(notes: DataFrame) -> DataFrame:
    """v1: the identity form is an error, a slug of the own source is fine, one of other sources only is a warning."""
    frozen = F.coalesce((F.col("status") == "frozen") | (F.col("kind") == "decision"), F.lit(False))
    links = notes.filter(~frozen).select("source", "path", F.explode("links").alias("slug")).withColumn("slug", F.trim("slug")).filter("slug <> ''")
    owners = notes.select("slug", F.col("source").alias("owner")).distinct().groupBy("slug").agg(F.sort_array(F.collect_set("owner")).alias("owners"))
    rows = links.join(owners, "slug", "left").filter(~F.coalesce(F.array_contains("owners", F.col("source")), F.lit(False)) | F.contains("slug", F.lit(":")))
    shape, elsewhere = F.contains("slug", F.lit(":")), F.col("owners").isNotNull()
    code = F.when(shape, "V1-LINK-IDENTITY").when(elsewhere, "V1-LINK-FOREIGN").otherwise("V1-LINK-BROKEN")
    message = F.when(shape, F.concat("slug", F.lit(" has the form of an identity"))).when(elsewhere, F.concat("slug", F.lit(" is a note of "), F.array_join("owners", ", "))).otherwise(F.concat("slug", F.lit(" has no target")))
    return rows.select("source", code.alias("code"), F.when(~shape & elsewhere, "warning").otherwise("error").alias("severity"), "path", F.lit("links").alias("field"), message.alias("message"))


def known_paths(files: DataFrame) -> DataFrame:
    """(source, path) of files and of all directories above them."""
    return files.select("source", F.explode(prefixes(F.col("path"))).alias("path")).distinct()


def code_pointers(notes: DataFrame, files: DataFrame, contract: str = "v2") -> DataFrame:
    """notes(source, path, status, code): path-shaped pointers that aren't in the tree. v1 cuts an anchor, warns of
    ellipses and ignores values without a slash."""
    live = notes.filter(~F.coalesce(F.col("status") == "frozen", F.lit(False))).select("source", F.col("path").alias("note"), F.explode("code").alias("pointer"))
    dots = F.contains("pointer", F.lit("...")) | F.contains("pointer", F.lit("…")) if contract == "v1" else F.lit(False)
    shaped = F.contains("pointer", F.lit("/")) | (F.contains("pointer", F.lit("\\")) if contract == "v2" else F.lit(False))
    clean = F.trim(F.substring_index("pointer", "#", 1)) if contract == "v1" else F.col("pointer")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\A(\./)+", ""), r"/+\z", "")
    rows = live.select("source", "note", "pointer", dots.alias("dots"), clean.alias("path")).filter(shaped | dots)
    missing = rows.filter("not dots").join(known_paths(files), ["source", "path"], "left_anti").select("source", F.col("note").alias("path"), "pointer")
    out = _rows(missing, "KBV2-CODE-BROKEN", "warning", "code", "code pointer does not resolve from the Git root")
    if contract == "v1":
        out = out.unionByName(_rows(rows.filter("dots").select("source", F.col("note").alias("path"), "pointer"), "V1-CODE-ELLIPSIS", "warning", "code", F.concat("pointer", F.lit(" is cut by an ellipsis"))))
    return out


def reference_edges(notes: DataFrame) -> DataFrame:
    """(source, path, target, via): metadata links and ``[[slug]]``, ``[[slug#anchor]]``, ``[[slug|alias]]`` of the text."""
    meta = notes.select("source", "path", F.explode("links").alias("target")).select("source", "path", F.trim("target").alias("target"), F.lit("metadata").alias("via"))
    wiki = F.regexp_extract_all("content", F.lit(r"\[\[\s*([^\]|#\[]*?)\s*(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), 1)
    body = notes.select("source", "path", F.explode(wiki).alias("target")).withColumn("via", F.lit("wikilink"))
    return meta.unionByName(body).filter("target <> ''")


def reference_scan(notes: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """(target, source, path, metadata, wikilink): who cites a slug, for all slugs or those given."""
    edges = reference_edges(notes)
    if slugs is not None:
        edges = edges.join(slugs.select(F.col("slug").alias("target")).distinct(), "target", "left_semi")
    return edges.groupBy("target", "source", "path").agg(F.bool_or(F.col("via") == "metadata").alias("metadata"), F.bool_or(F.col("via") == "wikilink").alias("wikilink"))


def rewrite_references(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """notes(source, path, links, content) with new_links, new_content and n_replaced after moves(old_slug, new_slug).

    Only notes that cite a moved slug are joined; their moves come as one small map per note. Anchors and aliases
    stay. ``content`` is the body, ``links`` the metadata list, which a caller renders back."""
    cited = reference_edges(notes).join(moves.select(F.col("old_slug").alias("target"), "new_slug"), "target")
    table = cited.groupBy("source", "path").agg(F.array_sort(F.collect_set(F.struct("target", "new_slug"))).alias("moves"))
    rows = notes.join(table, ["source", "path"])
    hits = lambda text, old: F.size(F.split(text, F.concat(F.lit(r"\[\[\s*\Q"), old, F.lit(r"\E\s*(?=[#|]|\]\])")))) - 1
    # one pass over the text: a new slug is never taken for an old one
    pieces = F.split("content", r"(?=\[\[)")
    swap = lambda p: F.aggregate("moves", F.struct(p.alias("t"), F.lit(False).alias("done")), lambda a, m: F.when(a["done"] | ~F.regexp(a["t"], F.concat(F.lit(r"\A\[\[\s*\Q"), m["target"], F.lit(r"\E\s*(#[^\]|]*)?(\|[^\]]*)?\]\]"))), a).otherwise(F.struct(F.regexp_replace(a["t"], F.concat(F.lit(r"\A(\[\[\s*)\Q"), m["target"], F.lit(r"\E")), F.concat(F.lit("$1"), _replacement(m["new_slug"]))).alias("t"), F.lit(True).alias("done"))), lambda a: a["t"])
    table_ = F.map_from_entries("moves")
    links = F.transform("links", lambda x: F.coalesce(F.element_at(table_, F.trim(x)), x))
    in_links = F.size(F.filter("links", lambda x: F.map_contains_key(table_, F.trim(x))))
    in_text = F.aggregate("moves", F.lit(0), lambda a, m: a + hits(F.col("content"), m["target"]))
    return rows.select(*notes.columns, links.alias("new_links"), F.array_join(F.transform(pieces, swap), "").alias("new_content"), (in_links + in_text).alias("n_replaced"))


def _replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def body_lines(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """(source, path, line, text): one row per line, from 1."""
    return notes.select("source", "path", F.posexplode(F.split(text_col, r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def body_assets(notes: DataFrame, asset_prefixes: tuple[str, ...] = ASSET_PREFIXES, heading: str = "touched assets") -> DataFrame:
    """(source, path, asset): ids in list or table cells of the section, outside fences, up to the next heading."""
    lines = body_lines(notes).withColumn("text", F.trim("text"))
    order = Window.partitionBy("source", "path").orderBy("line")
    fence = F.startswith("text", F.lit("```"))
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).filter(~fence & (F.col("fences") % 2 == 0))
    head = F.startswith("text", F.lit("#"))
    named = head & F.contains(F.lower(F.regexp_replace("text", r"\A#+", "")), F.lit(heading))
    lines = lines.withColumns({"head": head, "opened": F.sum(named.cast("int")).over(order)})
    lines = lines.withColumn("heads", F.sum(F.when(F.col("opened") > 0, F.col("head").cast("int")).otherwise(0)).over(order))
    inside = lines.filter("heads = 1 and not head")
    cells = inside.select("source", "path", F.explode(F.split("text", r"\|")).alias("cell"))
    asset = F.trim(F.regexp_replace(F.trim("cell"), r"\A`+|`+\z", ""))
    return cells.select("source", "path", asset.alias("asset")).filter(asset_prefix(F.col("asset")).isin(*asset_prefixes)).distinct()


def asset_reconcile(notes: DataFrame, asset_prefixes: tuple[str, ...] = ASSET_PREFIXES) -> DataFrame:
    """notes(source, path, assets, content): assets in the metadata but not the section, and the other way round."""
    body = body_assets(notes, asset_prefixes).withColumn("in_body", F.lit(True))
    meta = notes.select("source", "path", F.explode("assets").alias("asset")).withColumn("asset", F.trim("asset")).filter("asset <> ''").distinct().withColumn("in_meta", F.lit(True))
    odd = meta.join(body, ["source", "path", "asset"], "full").filter("in_meta is null or in_body is null")
    message = F.when(F.col("in_body").isNull(), F.concat("asset", F.lit(" is in the metadata but not in the section"))).otherwise(F.concat("asset", F.lit(" is in the section but not in the metadata")))
    return _rows(odd.withColumn("m", message), "ASSET-MISMATCH", "warning", "assets", F.col("m"))


def asset_reuse(notes: DataFrame, least: int = REUSE) -> DataFrame:
    """(asset, n_notes, path): a row per decision that lists an asset which at least ``least`` of them list."""
    rows = notes.filter(F.col("kind") == "decision").select("path", F.explode("assets").alias("asset")).filter("trim(asset) <> ''").distinct()
    return rows.join(rows.groupBy("asset").agg(F.count("*").alias("n_notes")).filter(F.col("n_notes") >= least), "asset").select("asset", "n_notes", "path")


_OPENING = re.compile(r"\s*(`{3,}|~{3,})\s*([A-Za-z0-9_-]*)", re.ASCII)


def fenced(content: str, language: str) -> list[tuple[int, str, bool]]:
    """(first line of code, code, closed) of the language's blocks, in time in proportion to the text: only lines that may
    open or close a fence change the state (fence that is open, its language, first line)."""
    lines, found = re.split(r"\r?\n", content), []
    fence, lang, first = "", "", 0
    for i, text in enumerate(lines):
        if not fence:
            opening = _OPENING.match(text)
            if opening:
                fence, lang, first = opening[1], opening[2].lower(), i + 1
        elif text.lstrip(" ").startswith(fence):
            if lang == language:
                found.append((first + 1, "\n".join(lines[first:i]), True))
            fence = ""
    if fence and lang == language:
        found.append((first + 1, "\n".join(lines[first:]), False))
    return found


def diagram_blocks(notes: DataFrame, language: str = "mermaid") -> DataFrame:
    """(source, path, line, code, closed): fenced blocks of the language with the first line of their code. A fence
    inside a block of another language opens nothing. Python sees only notes with a line that opens one."""

    @F.pandas_udf("array<struct<line:int,code:string,closed:boolean>>")
    def blocks(content: pd.Series) -> pd.Series:
        return content.map(lambda text: [{"line": n, "code": code, "closed": closed} for n, code, closed in fenced(text, language)])

    opens = notes.filter(F.col("content").rlike(rf"(?mi)^\s*(`{{3,}}|~{{3,}})\s*\Q{language}\E"))
    return opens.select("source", "path", F.inline(blocks("content")))


def catalog(notes: DataFrame) -> DataFrame:
    """(source, catalog): a heading per domain and a line per note that isn't an index, in order of domain and path. A
    catalog is the text of one file, so its lines (some 100 bytes a note, no bodies) meet in one row per source: up to
    some ten million notes a source."""
    rows = notes.filter(~F.col("is_domain_index"))
    line = F.concat(F.lit("- ["), "identity", F.lit("]("), "path", F.lit(") — "), "description")
    per = rows.groupBy("source", "domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    part = F.struct("domain", F.concat(F.lit("### "), "domain", F.lit("\n"), "lines").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n")
    return per.groupBy("source").agg(body.alias("body")).select("source", F.concat_ws("\n", F.lit(START), F.nullif("body", F.lit("")), F.lit(END)).alias("catalog"))


def _line_count(text: Column, marker: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?m)^\Q{marker}\E\r?$"))


def catalog_findings(indexes: DataFrame, catalogs: DataFrame) -> DataFrame:
    """indexes(source, path, content) against catalogs: marker errors, or drift of the region between them."""
    text = F.col("content")
    n, m = _line_count(text, START), _line_count(text, END)
    region = F.regexp_extract(text, rf"(?ms)^(\Q{START}\E\r?$.*^\Q{END}\E)\r?$", 1)
    rows = indexes.join(catalogs, "source", "left").withColumn("expected", F.coalesce("catalog", F.lit(f"{START}\n{END}")))
    message = (
        F.when((n == 0) | (m == 0), "human index markers are missing")
        .when((n > 1) | (m > 1), "human index markers must occur exactly once")
        .when(region == "", "human index end marker must follow start marker")
        .when(region != F.col("expected"), "human index generated catalog is out of date")
    )
    hit = rows.withColumn("message", message).filter("message is not null")
    code = F.when(F.col("message").endswith("out of date"), "KBV2-HUMAN-INDEX-DRIFT").otherwise("KBV2-HUMAN-INDEX-MARKER")
    return hit.select("source", code.alias("code"), F.lit("error").alias("severity"), "path", F.lit(None).cast("string").alias("field"), "message")


def _around(text: Column) -> tuple[Column, Column]:
    at, stop = F.instr(text, F.lit(START)), F.instr(text, F.lit(END))
    return F.substring(text, F.lit(1), at - 1), F.substring(text, stop + len(END), F.length(text))


def plan_catalog(indexes: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(source, path, replacement, prefix_sha, suffix_sha) of indexes whose markers are sound."""
    bad = catalog_findings(indexes, catalogs).filter("code = 'KBV2-HUMAN-INDEX-MARKER'").select("source", "path")
    prefix, suffix = _around(F.col("content"))
    rows = indexes.join(bad, ["source", "path"], "left_anti").join(catalogs, "source", "left")
    return rows.select("source", "path", F.coalesce("catalog", F.lit(f"{START}\n{END}")).alias("replacement"), F.sha2(prefix, 256).alias("prefix_sha"), F.sha2(suffix, 256).alias("suffix_sha"))


def apply_catalog(plan: DataFrame, indexes: DataFrame) -> DataFrame:
    """(source, path, new_content, rejected): what surrounds the region must be as planned, else nothing changes."""
    prefix, suffix = _around(F.col("content"))
    rows = plan.join(indexes, ["source", "path"])
    good = (F.sha2(prefix, 256) == F.col("prefix_sha")) & (F.sha2(suffix, 256) == F.col("suffix_sha")) & F.contains("content", F.lit(START)) & F.contains("content", F.lit(END))
    return rows.select("source", "path", F.when(good, F.concat(prefix, "replacement", suffix)).otherwise(F.col("content")).alias("new_content"), (~good).alias("rejected"))


def check_all(discovery: DataFrame, later: list[DataFrame]) -> DataFrame:
    """Discovery's diagnostics, and the other checks' for sources where discovery found no error."""
    failed = discovery.filter("severity = 'error'").select("source").distinct()
    out = discovery
    for rows in later:
        out = out.unionByName(rows.join(failed, "source", "left_anti"))
    return out


def slug_of(path: Column) -> Column:
    return stem(path)
