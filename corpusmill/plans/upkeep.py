"""Queries on synchronisation, references, catalogs, audit, lifecycle, telemetry, streams and snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import POINT_NAMESPACE, blob_sha256, point_id
from ..operators import audit, catalogs, checks, conform, lifecycle, semantic, sync, telemetry
from ..sources import ndjson, snapshots
from ..sources.keyed import KeyedTable
from ..sources.storage import materialise, new_path
from ..streaming import inbox, incremental
from .standins import DOCS_SQL, EMBED_SQL, docs, table
from .structure import with_odd_fences


def _n():
    return F.col("doc_id")


def point_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", point_id(F.col("identity")).alias("point_id"))


def blob_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", blob_sha256(F.coalesce("text", F.lit(""))).alias("blob_sha256"))


def wanted(spark, sf_dir):
    """Documents that are still there; every eleventh is gone."""
    return sync.desired_points(docs(spark, sf_dir).filter("doc_id % 11 <> 0"))


def points(spark, sf_dir):
    """The index before: no point for every tenth document, other texts, kinds and units for some; two sources retired
    under new names and points without documents."""
    p = sync.desired_points(docs(spark, sf_dir), others=["doc_id"]).filter("doc_id % 10 <> 0")
    p = p.withColumns({"text_hash": F.when(_n() % 7 == 1, F.sha2(F.concat(F.lit("old"), "text"), 256)).otherwise(F.col("text_hash")), "kind": F.when(_n() % 5 == 2, F.lit("spec")).otherwise(F.col("kind"))})
    extra = F.when(_n() % 4 == 0, F.concat_ws(":", "source", F.lit("gone"), "doc_id"))
    retired = F.when(_n() % 9 == 0, F.concat_ws(":", F.concat(F.lit("retired"), _n() % 2), "domain", "doc_id"))
    p = p.withColumn("identity", F.explode(F.array_compact(F.array("identity", extra, retired))))
    return p.select(point_id(F.col("identity")).alias("point_id"), *sync.PAYLOAD, F.array(_n().cast("float"), F.lit(1.0).cast("float")).alias("vector"))


def planned(spark, sf_dir):
    """What is wanted, without texts, and the index before: written once, as plans and guards read them many times."""
    return materialise(wanted(spark, sf_dir).drop("text"), "wanted"), materialise(points(spark, sf_dir), "points")


def sync_actions(spark, sf_dir):
    return sync.plan_actions(wanted(spark, sf_dir), points(spark, sf_dir)).select("identity", "action")


def vector_reuse(spark, sf_dir):
    return sync.plan_actions(wanted(spark, sf_dir), points(spark, sf_dir)).filter("action = 'rekey'").select("identity", "reuse_id")


def sync_report(spark, sf_dir):
    new, old = planned(spark, sf_dir)
    return sync.sync_report(sync.plan_actions(new, old), None, sync.prune_plan(old, new))


def prune_plan(spark, sf_dir):
    return sync.prune_plan(points(spark, sf_dir), wanted(spark, sf_dir)).drop("point_id")


def retired_sources(spark, sf_dir):
    rows = points(spark, sf_dir).select(sync.source_of(F.col("identity")).alias("source"))
    return sync.retired_sources(rows, table(spark, sf_dir, "documents").select("source"), by="rows")


def stale_compiled(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sync.stale_compiled(d, d.filter("doc_id % 11 <> 0"))


def orphans(spark, sf_dir):
    return sync.orphans(points(spark, sf_dir), docs(spark, sf_dir)).select("identity")


def coverage_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    indexed = d.filter("doc_id % 17 = 0").select("source", F.concat("lang", F.lit("/sub")).alias("domain")).distinct()
    sources = d.select("source").distinct().withColumn("present", F.length("source") > 4)
    found = d.join(sources.filter("present"), "source").select("source", F.col("lang").alias("domain")).distinct()
    return sync.coverage_diff(sources, found, indexed)


def apply_sync(spark, sf_dir):
    """The point table after a run with an embedder of two numbers: a second run finds nothing to do."""
    asked, old = planned(spark, sf_dir)
    plan = materialise(sync.plan_actions(asked, old), "plan")
    done = materialise(semantic.embed_rows(sync.to_embed(plan, wanted(spark, sf_dir)), _embed, 2), "embedded")
    new = materialise(sync.apply_plan(plan, old, done, sync.prune_plan(old, asked, force=True)), "points")
    return sync.plan_actions(asked, new).groupBy("action").agg(F.count("*").alias("n"))


def synced_points(spark, sf_dir):
    """The same run on a table kept in buckets, with guarded pruning: each point it holds then, with its vector as whole
    numbers, and how many buckets the run writes when it is repeated."""
    held = KeyedTable.create(points(spark, sf_dir).select("point_id", "vector", *sync.PAYLOAD), new_path(spark, "point-table"), "point_id", 32)
    asked, embed = wanted(spark, sf_dir), lambda rows: semantic.embed_rows(rows, _embed, 2)
    sync.apply_to(held, asked, embed, lambda all_: sync.prune_plan(all_, asked))
    again = sync.apply_to(held, asked, embed)[1]
    vector = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 256).cast("long").cast("string")), ",")
    return held.read().select("identity", "text_hash", "kind", vector.alias("vector"), F.lit(again).cast("long").alias("written_again"))


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in model: two numbers from a hash of the text; it refuses texts that start with ``Au``."""
    if any(t.startswith("Au") for t in texts):
        raise ValueError("refused")
    return [[b / 256 for b in hashlib.sha256(t.encode()).digest()[:2]] for t in texts]


def embed_rows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("identity", F.col("body_text").alias("text"))
    return semantic.embed_rows(rows, _embed, 2).select("identity", F.size("vector").alias("dim"), "error")


def _linked(spark, sf_dir):
    """Documents as notes with links, code pointers and assets by doc_id."""
    d = docs(spark, sf_dir)
    links = F.array((_n() * 2 + 1).cast("string"), F.when(_n() % 3 == 0, F.concat_ws(":", "source", "domain", _n())).otherwise(F.concat_ws(":", "source", "domain", _n() + 1)))
    code = F.array(F.concat(F.lit("en/"), _n() * 2 + 1, F.lit(".md")), F.when(_n() % 2 == 0, "symbol").otherwise("fr"))
    assets = F.array(F.concat(F.lit("repo:r"), F.floor(_n() / 8)), F.concat(F.lit("img:"), "domain"))
    return d.select("doc_id", "source", F.col("source_path").alias("path"), "domain", "identity", "status", "kind", _n().cast("string").alias("slug"), links.alias("links"), code.alias("code"), assets.alias("assets"), "description", "body_text", F.lit(False).alias("is_domain_index"))


def broken_links(spark, sf_dir):
    return checks.broken_links(_linked(spark, sf_dir)).select("source", "path", "message")


def broken_links_v1(spark, sf_dir):
    return checks.broken_links_v1(_linked(spark, sf_dir)).select("source", "path", "code", "severity")


def code_pointers(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    return checks.code_pointers(linked, linked.select("source", "path")).select("source", "path", "code")


def _wiki(spark, sf_dir):
    """Whole texts with links behind them."""
    text = F.concat("body_text", F.lit("\nsee [["), _n() + 5, F.lit("#part]], [["), _n() + 1, F.lit("|name]] and [[x]]"))
    return _linked(spark, sf_dir).withColumn("content", text)


def reference_scan(spark, sf_dir):
    return checks.reference_scan(_wiki(spark, sf_dir))


def _moves(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id % 50 = 7").select(_n().cast("string").alias("old_slug"), F.concat(F.lit("new-"), "doc_id").alias("new_slug"))


def rewrite_links(spark, sf_dir):
    return checks.rewrite_references(_wiki(spark, sf_dir), _moves(spark, sf_dir)).select("source", "path", F.array_join("new_links", ",").alias("new_links"), F.sha2("new_content", 256).alias("content_sha256"), "n_replaced")


def asset_reconcile(spark, sf_dir):
    """Whole texts with a section of assets behind them."""
    text = F.concat("body_text", F.lit("\n# Title\n## Touched Assets\n| `repo:r"), F.floor(_n() / 9), F.lit("` | img:"), "domain", F.lit(" |\n```\nimg:fenced\n```\n## Next\n- svc:late\n"))
    return checks.asset_reconcile(_linked(spark, sf_dir).withColumn("content", text)).select("source", "path", "message")


def asset_reuse(spark, sf_dir):
    return checks.asset_reuse(_linked(spark, sf_dir)).select("asset", "n_notes", "path")


def diagram_blocks(spark, sf_dir):
    """Whole texts with fences behind them."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n```mermaid\ngraph "), "doc_id", F.lit("\n```\n~~~text\n```mermaid\n~~~\n```Mermaid\nopen"))
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), text.alias("content"))
    return checks.diagram_blocks(d)


def catalog(spark, sf_dir):
    return checks.catalog(_linked(spark, sf_dir))


def _indexes(spark, sf_dir):
    """Index files by source: in order, out of date, without, with twofold, and with reversed markers."""
    c = checks.catalog(_linked(spark, sf_dir))
    i = F.substring("source", 4, 9).cast("int") % 5
    text = F.when(i == 0, F.concat(F.lit("top\n"), "catalog", F.lit("\nend"))).when(i == 1, F.lit(f"{checks.START}\n{checks.END}\n")).when(i == 2, F.lit("no markers")).when(i == 3, F.lit(f"{checks.START}\n{checks.START}\n{checks.END}")).otherwise(F.lit(f"{checks.END}\n{checks.START}"))
    return c.select("source", F.lit("INDEX.md").alias("path"), text.alias("content")), c


def catalog_drift(spark, sf_dir):
    return checks.catalog_findings(*_indexes(spark, sf_dir)).select("source", "code", "message")


def apply_catalog(spark, sf_dir):
    indexes, c = _indexes(spark, sf_dir)
    new = checks.apply_catalog(checks.plan_catalog(indexes, c), indexes).select("source", "path", F.col("new_content").alias("content"))
    return checks.catalog_findings(new, c).select("source", "code").union(new.select("source", F.lit("applied")))


def catalog_lines(spark, sf_dir):
    """Catalogs as ordered lines."""
    return catalogs.catalog_lines(_linked(spark, sf_dir))


def _index_lines(spark, sf_dir):
    """Lines of the index files, and of the catalogs that they should hold."""
    return catalogs.split_lines(_indexes(spark, sf_dir)[0]), materialise(catalog_lines(spark, sf_dir), "catalog-lines")


def catalog_line_drift(spark, sf_dir):
    return catalogs.line_findings(*_index_lines(spark, sf_dir)).select("source", "code", "message")


def catalog_line_writes(spark, sf_dir):
    """Index files with their regions replaced, written in parts and read back: size and content of each, and the findings
    that are left."""
    lines, catalog = _index_lines(spark, sf_dir)
    lines, root = materialise(lines, "index-lines"), new_path(spark, "index-parts")
    catalogs.write_lines(catalogs.apply_lines(catalogs.plan_lines(lines), lines, catalog)[0], root)
    back = materialise(catalogs.read_lines(spark, root), "written-lines")
    left = catalogs.line_findings(back, catalog).groupBy("source").agg(F.count("*").alias("n_findings"))
    per = back.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("n").cast("string"), "value")), 1, 8), 16, 10).cast("long")).alias("checksum"))
    return per.join(left, "source", "left").select("source", "n_lines", "checksum", F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"))


def check_rollup(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    failed = linked.filter("doc_id % 97 = 0").select("source", F.lit("X").alias("code"), F.lit("error").alias("severity"), "path", F.lit(None).cast("string").alias("field"), F.lit("").alias("message"))
    return checks.check_all(failed, [checks.broken_links(linked), checks.code_pointers(linked, linked.select("source", "path"))]).groupBy("source", "code").agg(F.count("*").alias("n"))


def orders(spark, sf_dir):
    """Orders as committed notes: frozen where the status is F, a decision where it is P."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    header = F.when(F.col("o_orderstatus") == "F", "---\nstatus: frozen\n---\n").when(F.col("o_orderstatus") == "P", "---\nkind: decision\n---\n").otherwise("---\nkind: note\n---\n")
    return o.select("o_orderkey", F.lit("s").alias("source"), F.concat(F.lit("d/"), "o_orderkey", F.lit(".md")).alias("path"), F.concat(header, F.lit("order "), "o_orderkey").alias("content"))


OID = "0" * 40


def history(spark, sf_dir):
    """(head, staged, changes, ledger): every third order changes, by kind of its key; records for some of them."""
    head = orders(spark, sf_dir)
    k = F.col("o_orderkey")
    touched = head.filter("o_orderkey % 3 = 0")
    target = F.concat(F.lit("a/"), k, F.lit(".md"))
    changes = touched.select("source", F.when(k % 4 == 0, "D").when(k % 4 == 1, "R100").when(k % 4 == 2, "M").otherwise("T").alias("status"), F.col("path").alias("old_path"), F.when(k % 4 == 1, target).alias("new_path"))
    added = touched.filter("o_orderkey % 4 = 0").select("source", F.lit("A").alias("status"), target.alias("old_path"), F.lit(None).cast("string").alias("new_path"))
    edited = F.when(k % 4 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    staged = touched.filter("o_orderkey % 4 < 3").select("source", F.when(k % 4 == 2, F.col("path")).otherwise(target).alias("path"), edited.alias("content"))
    record = touched.filter("o_orderkey % 5 < 3 and o_orderkey % 4 < 3").select(
        "source", F.lit(audit.SCHEMA).alias("schema"), F.when(k % 4 == 2, "amend").otherwise("relocate").alias("operation"), F.lit("s").alias("logical_source"),
        F.concat(F.lit("s:d:"), k).alias("old_identity"), F.when(k % 4 == 2, F.concat(F.lit("s:d:"), k)).otherwise(F.concat(F.lit("s:a:"), k)).alias("new_identity"),
        F.col("path").alias("old_path"), F.when(k % 4 == 2, F.col("path")).otherwise(target).alias("new_path"), F.lit(OID).alias("head_oid"),
        F.when(k % 5 == 1, F.lit("f" * 64)).otherwise(blob_sha256(edited)).alias("canonical_git_blob_sha256"), F.lit("moved").alias("reason"),
    )
    return head, staged, changes.union(added), record


def frozen_gate(spark, sf_dir):
    head, staged, changes, ledger = history(spark, sf_dir)
    oid = spark.createDataFrame([("s", OID)], "source string, oid string")
    return audit.staged_findings(changes, head, staged, ledger, oid).select("old_path", "status", "problem")


def unused_records(spark, sf_dir):
    head, staged, changes, ledger = history(spark, sf_dir)
    return audit.unused_records(ledger, changes, staged, head).select("old_path", "operation")


def unapproved_edits(spark, sf_dir):
    head = orders(spark, sf_dir)
    work = head.withColumn("content", F.when(F.col("o_orderkey") % 2 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    approvals = head.filter("o_orderkey % 6 = 0").select("source", "path", F.when(F.col("o_orderkey") % 4 == 0, "fine").otherwise(" ").alias("reason"))
    return audit.unapproved_edits(head, work, approvals).select("path")


def ledger_violations(spark, sf_dir):
    _, _, _, ledger = history(spark, sf_dir)
    k = F.substring_index(F.substring_index("old_path", "/", -1), ".", 1).cast("long")
    bad = ledger.withColumn("k", k).withColumns({"reason": F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("reason")), "head_oid": F.when(F.col("k") % 7 == 1, "xyz").otherwise(F.col("head_oid")), "new_path": F.when(F.col("k") % 7 == 2, "../out.md").otherwise(F.col("new_path"))})
    lines = bad.select("source", F.col("k").alias("line"), F.concat(F.to_json(F.struct(*audit.LEDGER_COLUMNS)), F.when(F.col("k") % 7 == 3, " ").otherwise("")).alias("value"))
    return audit.ledger_violations(lines).select("line", "code")


def ledger_pairing(spark, sf_dir):
    _, _, _, ledger = history(spark, sf_dir)
    left, right = ledger.filter("length(old_path) % 2 = 0 or operation = 'amend'"), ledger.filter("operation = 'relocate'")
    return audit.unpaired_records(left, right).select("old_path", "side")


def append_only(spark, sf_dir):
    """Ledgers of documents' lines: sources with an even number rewrite a line, those with a zero add nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.substring("source", 4, 9).cast("int")
    head = d.filter("doc_id % 2 = 0").select("source", _n().alias("line"), F.lit("a").alias("value"))
    staged = d.filter((_n() % 2 == 0) | (i % 5 != 0)).select("source", _n().alias("line"), F.when((i % 2 == 0) & (_n() % 10 == 0), "b").otherwise("a").alias("value"))
    return audit.new_ledger_lines(head, staged)[0].select("source", "line", "problem")


def move_plan(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", F.col("source_path").alias("path"), "identity", _n().cast("string").alias("slug"), F.lit(False).alias("is_domain_index"), F.when(_n() % 2 == 0, "---\nstatus: frozen\n---\n").otherwise("x").alias("content"), F.col("domain").alias("lang"))
    domains = d.select("source", F.col("lang").alias("dir"), F.col("lang").alias("domain")).distinct()
    head = d.filter("doc_id % 7 <> 0").select("source", "path", F.when(_n() % 3 == 0, F.concat("content", F.lit("old"))).otherwise(F.col("content")).alias("content"))
    target = F.when(_n() % 4 == 0, F.concat("source", F.lit(":none"))).when(_n() % 4 == 1, F.concat_ws(":", "source", "lang")).when(_n() % 4 == 2, F.concat_ws(":", "source", "lang", F.concat(F.lit("m"), "doc_id"))).otherwise(F.lit("bad"))
    moves = d.select("source", "path", target.alias("target"))
    return audit.plan_moves(moves, d, domains, head).select("source", "path", F.array_join("problems", "; ").alias("problems"), "ok")


def capture_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ts = F.concat(F.lit("2024-01-0"), F.col("turn") % 9 + 1)
    return inbox.captured(c.select("conv_id", "turn", ts.alias("ts"), "text"), ["conv_id", "turn"])


def capture_notes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    box = c.select(F.col("role").alias("source"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 5).alias("ts"), F.col("text").alias("title"), F.col("text").alias("body"), F.lit("").alias("origin"))
    return lifecycle.plan_captures(box).select("source", "path", F.sha2("content", 256).alias("content_sha256"))


def promotion_gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"path": F.concat_ws("/", "conv_id", "turn"), "i": F.col("conv_id") + F.col("turn")})
    i = F.col("i")
    held = F.when(i % 4 == 0, "raw").when(i % 4 == 1, "derived").when(i % 4 == 2, "unclassified")
    target = F.when(i % 3 == 0, "Derived").when(i % 3 == 1, "canonical ").otherwise("lost")
    day = F.when(i % 5 == 0, "2024-02-30").when(i % 5 == 1, "").otherwise("2024-02-29")
    facts = F.when(i % 2 == 0, F.array(F.lit(" "), F.lit("seen"))).otherwise(F.array(F.lit(" ")))
    asked = c.select(F.col("role").alias("source"), "path", target.alias("target_status"), day.alias("last_verified"), facts.alias("evidence"))
    return lifecycle.promotion_gate(asked, c.select(F.col("role").alias("source"), "path", held.alias("status"))).select("source", "path", "problem")


def rewrite_headers(spark, sf_dir):
    value = lambda s, many: F.struct(F.lit(s).cast("string").alias("scalar"), F.lit(many).cast("array<string>").alias("items"))
    updates = F.create_map(F.lit("status"), value("derived", None), F.lit("evidence"), value(None, None).withField("items", F.array(F.lit("a"), F.lit('b "c"'))))
    rows = with_odd_fences(spark, sf_dir).withColumn("updates", updates)
    return conform.rewrite_fields(rows).select("doc_id", F.sha2("new_content", 256).alias("content_sha256"))


def call_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("verb"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"))
    return telemetry.call_stats(calls).withColumn("error_rate", F.round("error_rate", 6))


def stream_capture(spark, sf_dir):
    """The inbox as a stream of the conversations' files, drained once, read back from its table."""
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema.simpleString()[7:-1]
    stream = inbox.read_inbox(spark, f"{sf_dir}/conversations.parque[t]", ", ".join(p.replace(":", " ", 1) for p in schema.split(",")))
    ts = F.concat(F.lit("2024-01-0"), F.col("turn") % 9 + 1)
    out = new_path(spark, "inbox")
    inbox.write_inbox(inbox.captured(stream.select("conv_id", "turn", ts.alias("ts"), "text"), ["conv_id", "turn"]), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("conv_id", "turn", F.col("day").cast("string").alias("day"), "line")


def stream_sync(spark, sf_dir):
    """Two drops of changed documents as a stream, synchronised batch by batch; the plan of a last full run."""
    d = docs(spark, sf_dir).withColumn("version", F.lit(1))
    drop = new_path(spark, "changes")
    d.filter("doc_id % 2 = 0").drop("doc_id").coalesce(4).write.parquet(drop)
    d.filter("doc_id % 3 = 0").withColumn("version", F.lit(2)).drop("doc_id").coalesce(4).write.mode("append").parquet(drop)
    empty = sync.desired_points(docs(spark, sf_dir)).limit(0).withColumn("vector", F.array().cast("array<float>")).select("point_id", "vector", *sync.PAYLOAD)
    held = KeyedTable.create(empty, new_path(spark, "point-table"), "point_id", 16)
    changes = spark.readStream.schema(d.drop("doc_id").schema).option("maxFilesPerTrigger", 4).parquet(drop)
    incremental.stream_sync(changes, held, lambda t: [[float(len(x))] for x in t], 1, new_path(spark, "sync-checkpoint")).awaitTermination()
    return sync.plan_actions(sync.desired_points(docs(spark, sf_dir)), held.read()).select("identity", "action")


def snapshot_publish(spark, sf_dir):
    """Builds, validates and publishes a snapshot; what readers then see."""
    root = new_path(spark, "snapshots")
    d = docs(spark, sf_dir).drop("doc_id")
    snapshots.publish(spark, root, snapshots.build(d, root))
    return snapshots.current(spark, root).groupBy("source").agg(F.count("*").alias("n"))


def ndjson_round_trip(spark, sf_dir):
    """Canonical lines written, validated and read again: no violation, every document."""
    path = new_path(spark, "ndjson")
    ndjson.write_canonical(docs(spark, sf_dir).drop("doc_id"), path)
    bad = ndjson.validate_lines(ndjson.read_lines(spark, path))
    good = ndjson.read_docs(spark, path)
    return good.select("identity", "source_hash", F.lit("ok").alias("state")).unionByName(bad.select(F.col("code").alias("identity"), F.lit("").alias("source_hash"), F.col("message").alias("state")))


QUERIES = {f.__name__: f for f in (point_ids, blob_digests, sync_actions, vector_reuse, sync_report, prune_plan, retired_sources, stale_compiled, orphans, coverage_diff, apply_sync, synced_points, embed_rows, broken_links, broken_links_v1, code_pointers, reference_scan, rewrite_links, asset_reconcile, asset_reuse, diagram_blocks, catalog, catalog_drift, apply_catalog, catalog_lines, catalog_line_drift, catalog_line_writes, check_rollup, frozen_gate, unused_records, unapproved_edits, ledger_violations, ledger_pairing, append_only, move_plan, capture_lines, capture_notes, promotion_gate, rewrite_headers, call_stats, stream_capture, stream_sync, snapshot_publish, ndjson_round_trip)}


def _pid(identity: str) -> str:
    h = f"sha1(unhex('{POINT_NAMESPACE.hex}') || encode({identity} || ':whole'))"
    return f"(SELECT concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20], h[21:32]) FROM (SELECT {h} AS h))"


_T = f"t AS (SELECT *, {EMBED_SQL} AS text FROM docs), th AS (SELECT *, sha256(text) AS text_hash FROM t)"
_OLD = """old0 AS (SELECT doc_id, source, identity, CASE WHEN doc_id % 7 = 1 THEN sha256('old' || text) ELSE text_hash END AS old_hash, kind AS true_kind, CASE WHEN doc_id % 5 = 2 THEN 'spec' ELSE kind END AS old_kind FROM th WHERE doc_id % 10 <> 0),
points AS (SELECT identity, old_hash, doc_id, old_kind <> true_kind AS changed FROM old0
  UNION ALL SELECT source || ':gone:' || doc_id, old_hash, doc_id, false FROM old0 WHERE doc_id % 4 = 0
  UNION ALL SELECT 'retired' || (doc_id % 2) || ':' || split_part(identity, ':', 2) || ':' || doc_id, old_hash, doc_id, false FROM old0 WHERE doc_id % 9 = 0),
wanted AS (SELECT * FROM th WHERE doc_id % 11 <> 0),
reuse AS (SELECT DISTINCT old_hash AS text_hash FROM points),
plan AS (SELECT w.identity, w.source, w.text_hash, CASE WHEN p.identity IS NOT NULL AND p.old_hash = w.text_hash THEN CASE WHEN p.changed THEN 'payload_update' ELSE 'unchanged' END
   WHEN p.identity IS NOT NULL THEN 'embed' WHEN r.text_hash IS NOT NULL THEN 'rekey' ELSE 'embed' END AS action
   FROM wanted w LEFT JOIN points p USING (identity) LEFT JOIN reuse r ON r.text_hash = w.text_hash),
own AS (SELECT split_part(identity, ':', 1) AS source, identity FROM points),
stale AS (SELECT * FROM own WHERE source IN (SELECT source FROM wanted) AND identity NOT IN (SELECT identity FROM wanted)),
prune AS (SELECT source, identity, n_stale, n_points, NOT n_stale > 0.5 * n_points AS allowed FROM stale JOIN (SELECT source, count(*) AS n_stale FROM stale GROUP BY 1) USING (source) JOIN (SELECT source, count(*) AS n_points FROM own GROUP BY 1) USING (source))"""
SYNC_SQL = f"WITH {DOCS_SQL}, {_T}, {_OLD}"
_EDGES = """linked AS (SELECT *, [(doc_id * 2 + 1)::VARCHAR, source || ':' || domain || ':' || CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1 END] AS links FROM docs),
edge AS (SELECT source, source_path AS path, domain, status, kind, doc_id, unnest(links) AS link FROM linked)"""
_LIVE = "coalesce(status, '') <> 'frozen'"
HEAD_SQL = """head AS (SELECT o_orderkey AS k, 'd/' || o_orderkey || '.md' AS path, o_orderstatus IN ('F', 'P') AS frozen,
  CASE o_orderstatus WHEN 'F' THEN '---' || chr(10) || 'status: frozen' || chr(10) || '---' || chr(10) WHEN 'P' THEN '---' || chr(10) || 'kind: decision' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'kind: note' || chr(10) || '---' || chr(10) END || 'order ' || o_orderkey AS content FROM orders),
c AS (SELECT *, CASE k % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R100' WHEN 2 THEN 'M' ELSE 'T' END AS status, k % 5 < 3 AND k % 4 < 3 AS recorded, k % 5 <> 1 AS right_blob FROM head WHERE k % 3 = 0)"""
_LINE = "'2024-01-0' || (turn % 9 + 1)"
_CAPTURE = rf"SELECT conv_id, turn, {_LINE} AS day, '- ' || {_LINE} || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''"
_CATALOG = f"""lines AS (SELECT source, domain, string_agg('- [' || identity || '](' || source_path || ') — ' || description, chr(10) ORDER BY source_path) AS body FROM docs GROUP BY 1, 2),
cat AS (SELECT source, '{checks.START}' || chr(10) || string_agg('### ' || domain || chr(10) || body, chr(10) ORDER BY domain) || chr(10) || '{checks.END}' AS catalog FROM lines GROUP BY 1)"""
_IDX = "(substr(source, 4)::INT % 5)"
ORACLE_SQL = {
    "point_ids": f"WITH {DOCS_SQL} SELECT doc_id, {_pid('identity')} AS point_id FROM docs",
    "blob_digests": "SELECT doc_id, sha256(encode('blob ' || octet_length(encode(coalesce(text, '')))) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS blob_sha256 FROM documents",
    "sync_actions": f"{SYNC_SQL} SELECT identity, action FROM plan",
    "apply_sync": f"{SYNC_SQL} SELECT 'unchanged' AS action, count(*) AS n FROM wanted",
    "synced_points": f"""{SYNC_SQL}, held AS (SELECT p.*, o.old_kind FROM points p JOIN old0 o USING (doc_id)),
      lend AS (SELECT old_hash, arg_min(doc_id, pid) AS lender FROM (SELECT old_hash, doc_id, {_pid('identity')} AS pid FROM points) GROUP BY 1),
      now AS (SELECT w.identity, w.text_hash, w.kind, CASE action WHEN 'embed' THEN ('0x' || w.text_hash[1:2])::INT || ',' || ('0x' || w.text_hash[3:4])::INT WHEN 'rekey' THEN (lender * 256) || ',256' ELSE (p.doc_id * 256) || ',256' END AS vector
              FROM wanted w JOIN plan USING (identity) LEFT JOIN lend ON lend.old_hash = w.text_hash LEFT JOIN points p ON p.identity = w.identity)
      SELECT *, 0::BIGINT AS written_again FROM (SELECT * FROM now UNION ALL SELECT identity, old_hash, old_kind, (doc_id * 256) || ',256' FROM held
        WHERE identity NOT IN (SELECT identity FROM wanted) AND identity NOT IN (SELECT identity FROM prune WHERE allowed))""",
    "vector_reuse": f"{SYNC_SQL}, ids AS (SELECT old_hash, {_pid('identity')} AS pid FROM points) SELECT identity, min(pid) AS reuse_id FROM plan JOIN ids ON old_hash = text_hash WHERE action = 'rekey' GROUP BY 1",
    "sync_report": f"{SYNC_SQL} SELECT source, coalesce(unchanged, 0)::BIGINT AS unchanged, coalesce(payload_update, 0)::BIGINT AS payload_update, coalesce(rekey, 0)::BIGINT AS rekey, coalesce(embed, 0)::BIGINT AS embed, 0::BIGINT AS failed, coalesce(prunable, 0)::BIGINT AS prunable, coalesce(blocked, 0)::BIGINT AS blocked, CASE WHEN blocked > 0 THEN 2 ELSE 0 END AS exit_class FROM (SELECT source, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'payload_update') AS payload_update, count(*) FILTER (action = 'rekey') AS rekey, count(*) FILTER (action = 'embed') AS embed FROM plan GROUP BY 1) FULL JOIN (SELECT source, count(*) FILTER (allowed) AS prunable, count(*) FILTER (NOT allowed) AS blocked FROM prune GROUP BY 1) USING (source)",
    "prune_plan": f"{SYNC_SQL} SELECT * FROM prune",
    "retired_sources": f"{SYNC_SQL}, n AS (SELECT source, count(*) AS n_rows FROM own GROUP BY 1), g AS (SELECT * FROM n WHERE source NOT IN (SELECT source FROM documents)) SELECT source, n_rows, NOT (SELECT sum(n_rows) FROM g) > 0.5 * (SELECT sum(n_rows) FROM n) AS allowed FROM g",
    "stale_compiled": f"WITH {DOCS_SQL}, s AS (SELECT source, identity FROM docs WHERE doc_id % 11 = 0 AND source IN (SELECT source FROM docs WHERE doc_id % 11 <> 0)) SELECT source, identity, n_stale, n_stored, NOT 2 * n_stale > n_stored AS allowed FROM s JOIN (SELECT source, count(*) AS n_stale FROM s GROUP BY 1) USING (source) JOIN (SELECT source, count(*) AS n_stored FROM docs GROUP BY 1) USING (source)",
    "orphans": f"{SYNC_SQL} SELECT identity FROM points WHERE identity NOT IN (SELECT identity FROM docs)",
    "coverage_diff": "WITH s AS (SELECT DISTINCT source, length(source) > 4 AS present FROM documents), f AS (SELECT DISTINCT source, lang FROM documents WHERE length(source) > 4), i AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 17 = 0), m AS (SELECT source, count(*) AS n_domains, count(*) FILTER ((source, lang) NOT IN (SELECT (source, lang) FROM i)) AS n_missing FROM f GROUP BY 1) SELECT source, CASE WHEN NOT present THEN 'missing-repo' WHEN coalesce(n_domains, 0) = 0 THEN 'no-domains' WHEN n_missing > 0 THEN 'not-indexed' ELSE 'ok' END AS status, coalesce(n_domains, 0) AS n_domains, coalesce(n_missing, 0) AS n_missing FROM s LEFT JOIN m USING (source)",
    "embed_rows": f"WITH {DOCS_SQL} SELECT identity, CASE WHEN NOT starts_with(body_text, 'Au') THEN 2 END::INT AS dim, CASE WHEN starts_with(body_text, 'Au') THEN 'refused' END AS error FROM docs",
    "broken_links": f"WITH {DOCS_SQL}, {_EDGES}, r AS (SELECT source, path, CASE WHEN len(string_split(link, ':')) = 3 THEN link ELSE source || ':' || domain || ':' || link END AS target FROM edge WHERE {_LIVE}) SELECT source, path, 'link target does not resolve: ' || target AS message FROM r WHERE (source, target) NOT IN (SELECT (source, identity) FROM docs)",
    "broken_links_v1": f"WITH {DOCS_SQL}, {_EDGES}, o AS (SELECT doc_id::VARCHAR AS link, list(DISTINCT source) AS owners FROM docs GROUP BY 1) SELECT e.source, path, CASE WHEN contains(link, ':') THEN 'V1-LINK-IDENTITY' WHEN owners IS NOT NULL THEN 'V1-LINK-FOREIGN' ELSE 'V1-LINK-BROKEN' END AS code, CASE WHEN NOT contains(link, ':') AND owners IS NOT NULL THEN 'warning' ELSE 'error' END AS severity FROM edge e LEFT JOIN o USING (link) WHERE {_LIVE} AND kind <> 'decision' AND (contains(link, ':') OR NOT coalesce(list_contains(owners, e.source), false))",
    "code_pointers": f"WITH {DOCS_SQL}, p AS (SELECT source, source_path AS path, 'en/' || (doc_id * 2 + 1) || '.md' AS pointer FROM docs WHERE {_LIVE}) SELECT source, path, 'KBV2-CODE-BROKEN' AS code FROM p WHERE (source, pointer) NOT IN (SELECT (source, source_path) FROM docs)",
    "reference_scan": f"WITH {DOCS_SQL}, {_EDGES}, e AS (SELECT link AS target, source, path, true AS meta FROM edge UNION ALL SELECT unnest([(doc_id + 5)::VARCHAR, (doc_id + 1)::VARCHAR, 'x']), source, source_path, false FROM docs) SELECT target, source, path, bool_or(meta) AS metadata, bool_or(NOT meta) AS wikilink FROM e GROUP BY 1, 2, 3",
    "rewrite_links": f"WITH {DOCS_SQL}, r AS (SELECT *, doc_id * 2 + 1 AS l, doc_id + 5 AS a, doc_id + 1 AS b, source || ':' || domain || ':' || CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1 END AS full FROM docs), m AS (SELECT doc_id AS k FROM documents WHERE doc_id % 50 = 7), j AS (SELECT r.*, l IN (SELECT k FROM m) AS ml, a IN (SELECT k FROM m) AS ma, b IN (SELECT k FROM m) AS mb FROM r) SELECT source, source_path AS path, CASE WHEN ml THEN 'new-' ELSE '' END || l || ',' || \"full\" AS new_links, sha256(body_text || chr(10) || 'see [[' || CASE WHEN ma THEN 'new-' ELSE '' END || a || '#part]], [[' || CASE WHEN mb THEN 'new-' ELSE '' END || b || '|name]] and [[x]]') AS content_sha256, ml::INT + ma::INT + mb::INT AS n_replaced FROM j WHERE ml OR ma OR mb",
    "asset_reconcile": f"WITH {DOCS_SQL} SELECT source, source_path AS path, 'repo:r' || (doc_id // 8) || ' is in the metadata but not in the section' AS message FROM docs WHERE doc_id // 8 <> doc_id // 9 UNION ALL SELECT source, source_path, 'repo:r' || (doc_id // 9) || ' is in the section but not in the metadata' FROM docs WHERE doc_id // 8 <> doc_id // 9",
    "asset_reuse": f"WITH {DOCS_SQL}, a AS (SELECT DISTINCT source_path AS path, unnest(['repo:r' || (doc_id // 8), 'img:' || domain]) AS asset FROM docs WHERE kind = 'decision') SELECT asset, n_notes, path FROM a JOIN (SELECT asset, count(*) AS n_notes FROM a GROUP BY 1 HAVING count(*) >= 3) USING (asset)",
    "diagram_blocks": "WITH d AS (SELECT source, doc_id::VARCHAR AS path, doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) SELECT source, path, (n + 2)::INT AS line, 'graph ' || doc_id AS code, true AS closed FROM d UNION ALL SELECT source, path, (n + 8)::INT, 'open', false FROM d",
    "catalog": f"WITH {DOCS_SQL}, {_CATALOG} SELECT * FROM cat",
    "catalog_drift": f"SELECT DISTINCT source, CASE WHEN {_IDX} = 1 THEN 'KBV2-HUMAN-INDEX-DRIFT' ELSE 'KBV2-HUMAN-INDEX-MARKER' END AS code, CASE {_IDX} WHEN 1 THEN 'human index generated catalog is out of date' WHEN 2 THEN 'human index markers are missing' WHEN 3 THEN 'human index markers must occur exactly once' ELSE 'human index end marker must follow start marker' END AS message FROM documents WHERE {_IDX} > 0",
    "catalog_lines": f"WITH {DOCS_SQL}, {_CATALOG}, s AS (SELECT source, string_split(catalog, chr(10)) AS v FROM cat) SELECT source, unnest(range(1, len(v) + 1)) AS n, unnest(v) AS line FROM s",
    "catalog_line_drift": f"SELECT DISTINCT source, CASE WHEN {_IDX} = 1 THEN 'KBV2-HUMAN-INDEX-DRIFT' ELSE 'KBV2-HUMAN-INDEX-MARKER' END AS code, CASE {_IDX} WHEN 1 THEN 'human index generated catalog is out of date' WHEN 2 THEN 'human index markers are missing' WHEN 3 THEN 'human index markers must occur exactly once' ELSE 'human index end marker must follow start marker' END AS message FROM documents WHERE {_IDX} > 0",
    "catalog_line_writes": f"WITH {DOCS_SQL}, {_CATALOG}, s AS (SELECT source, string_split(CASE {_IDX} WHEN 0 THEN 'top' || chr(10) || catalog || chr(10) || 'end' ELSE catalog || chr(10) END, chr(10)) AS v FROM cat WHERE {_IDX} < 2), l AS (SELECT source, unnest(range(1, len(v) + 1)) AS n, unnest(v) AS line FROM s) SELECT source, count(*) AS n_lines, sum(('0x' || md5(n || ':' || line)[1:8])::BIGINT)::BIGINT AS checksum, 0::BIGINT AS n_findings FROM l GROUP BY 1",
    "apply_catalog": f"SELECT DISTINCT source, 'applied' AS code FROM documents WHERE {_IDX} < 2",
    "check_rollup": f"WITH {DOCS_SQL}, {_EDGES}, bad AS (SELECT source, doc_id FROM docs WHERE doc_id % 97 = 0), r AS (SELECT source, CASE WHEN len(string_split(link, ':')) = 3 THEN link ELSE source || ':' || domain || ':' || link END AS target FROM edge WHERE {_LIVE}), u AS (SELECT source, 'X' AS code FROM bad UNION ALL SELECT source, 'KBV2-LINK-BROKEN' FROM r WHERE (source, target) NOT IN (SELECT (source, identity) FROM docs) AND source NOT IN (SELECT source FROM bad) UNION ALL SELECT source, 'KBV2-CODE-BROKEN' FROM docs WHERE {_LIVE} AND (source, 'en/' || (doc_id * 2 + 1) || '.md') NOT IN (SELECT (source, source_path) FROM docs) AND source NOT IN (SELECT source FROM bad)) SELECT source, code, count(*) AS n FROM u GROUP BY 1, 2",
    "frozen_gate": f"WITH {HEAD_SQL} SELECT path AS old_path, status, CASE status WHEN 'T' THEN 'change of a frozen note is not allowed' WHEN 'M' THEN 'frozen note edited without a record' ELSE 'frozen note moved or deleted without a record' END AS problem FROM c WHERE frozen AND NOT (recorded AND right_blob)",
    "unused_records": f"WITH {HEAD_SQL} SELECT path AS old_path, CASE WHEN status = 'M' THEN 'amend' ELSE 'relocate' END AS operation FROM c WHERE recorded AND CASE WHEN status = 'M' THEN NOT frozen ELSE NOT right_blob END",
    "unapproved_edits": f"WITH {HEAD_SQL} SELECT path FROM head WHERE frozen AND k % 2 = 0 AND NOT (k % 6 = 0 AND k % 4 = 0)",
    "ledger_violations": f"WITH {HEAD_SQL}, r AS (SELECT k, status FROM c WHERE recorded) SELECT k AS line, CASE k % 7 WHEN 0 THEN 'LEDGER-REASON' WHEN 1 THEN 'LEDGER-OID' WHEN 2 THEN 'LEDGER-PATH' ELSE 'LEDGER-CANONICAL' END AS code FROM r WHERE k % 7 < 4 UNION ALL SELECT k, 'LEDGER-AMEND' FROM r WHERE k % 7 = 2 AND status = 'M'",
    "ledger_pairing": f"WITH {HEAD_SQL} SELECT path AS old_path, 'source' AS side FROM c WHERE recorded AND status = 'M' UNION ALL SELECT path, 'target' FROM c WHERE recorded AND status <> 'M' AND length(path) % 2 <> 0",
    "append_only": "WITH d AS (SELECT doc_id, source, substr(source, 4)::INT AS i FROM documents) SELECT source, doc_id AS line, 'rewritten' AS problem FROM d WHERE doc_id % 10 = 0 AND i % 2 = 0 UNION ALL SELECT DISTINCT source, NULL::BIGINT, 'nothing added' FROM d WHERE source NOT IN (SELECT source FROM d WHERE doc_id % 2 = 1 AND i % 5 <> 0) AND (doc_id % 2 = 0 OR i % 5 <> 0)",
    "move_plan": f"WITH {DOCS_SQL} SELECT source, source_path AS path, concat_ws('; ', CASE WHEN doc_id % 4 = 3 THEN 'target is not source:domain or source:domain:slug' END, CASE WHEN doc_id % 4 IN (0, 3) THEN 'target domain does not exist' END, CASE WHEN doc_id % 4 = 1 THEN 'target is the note itself' END, CASE WHEN doc_id % 7 = 0 THEN 'note is not committed' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 'frozen note differs from its commit' END, CASE WHEN (doc_id % 4 = 0 AND FALSE) THEN '' END) AS problems, false AS ok FROM docs",
    "capture_lines": _CAPTURE,
    "stream_capture": _CAPTURE,
    "capture_notes": r"""WITH c AS (SELECT role AS source, to_timestamp(1700000000 + conv_id % 5) AT TIME ZONE 'UTC' AS ts, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS title, trim(coalesce(text, '')) AS body FROM conversations),
s AS (SELECT *, regexp_replace(regexp_replace(title, '[^\p{L}\p{M}\p{N}\p{Pc}\-.]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug FROM c),
n AS (SELECT *, '000-raw/' || strftime(ts, '%Y/%m/%d/%H%M%S') || '-' || left(CASE WHEN slug = '' THEN 'untitled' ELSE slug END, 80) AS base FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY title, body) AS i FROM n)
SELECT source, CASE WHEN title <> '' THEN base || CASE WHEN i = 1 THEN '' ELSE '-' || CASE WHEN i < 100 THEN lpad(i::VARCHAR, 2, '0') ELSE i::VARCHAR END END || '.md' END AS path,
  CASE WHEN title <> '' THEN sha256('---' || chr(10) || 'status: raw' || chr(10) || 'captured_at: "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"' || chr(10) || 'source: "manual"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body || chr(10)) END AS content_sha256 FROM i""",
    "promotion_gate": "WITH c AS (SELECT role AS source, conv_id || '/' || turn AS path, conv_id + turn AS i FROM conversations), x AS (SELECT *, CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS held, CASE i % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS wanted FROM c) SELECT source, path, CASE WHEN wanted IS NULL THEN 'target status must be raw, derived, or canonical' WHEN held IS NULL THEN 'source status must be explicitly declared' WHEN wanted <> held + 1 THEN 'invalid lifecycle transition' WHEN wanted = 3 AND i % 5 < 2 THEN 'canonical promotion requires last_verified=YYYY-MM-DD' WHEN wanted = 3 AND i % 2 <> 0 THEN 'canonical promotion requires at least one evidence item' END AS problem FROM x",
    "call_stats": "SELECT event_type AS verb, count(*) AS n, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS error_rate FROM events WHERE event_type <> '' GROUP BY 1",
    "stream_sync": f"WITH {DOCS_SQL}, {_T}, seen AS (SELECT DISTINCT text_hash FROM th WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) SELECT identity, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'unchanged' WHEN text_hash IN (SELECT text_hash FROM seen) THEN 'rekey' ELSE 'embed' END AS action FROM th",
    "snapshot_publish": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "ndjson_round_trip": f"WITH {DOCS_SQL} SELECT identity, source_hash, 'ok' AS state FROM docs",
}
