"""Change audit: frozen notes, approvals, the append-only ledger, batch moves and amendments, as joins of tables.

Tables: head, staged, work (source, path, content), changes (source, status, old_path, new_path), ledger records with a
``record`` number, approvals (source, path, reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blob_sha256, fold, nfc, stem
from ..schemas import LEDGER, LEDGER_COLUMNS
from .diagnostics import diagnostic, only_hits

SCHEMA = "frozen-ledger-v2"


def header_value(content: Column, key: str) -> Column:
    """A bare or quoted scalar of the header, by expression: enough for status and kind."""
    header = F.regexp_extract(content, r"\A\x{FEFF}?---\r?\n((?:(?!---\r?(?:\n|\z))[^\n]*\n)*+)---(?:\r?\n|\r?\z)", 1)
    return F.regexp_extract(header, rf"(?m)^{key}:[ \t]*[\"']?([^\"'#\r\n]*?)[\"']?[ \t]*(?:[ \t]#[^\n]*)?\r?$", 1)


def is_frozen(content: Column) -> Column:
    """Status frozen, or kind decision; only committed content decides."""
    return (header_value(content, "status") == "frozen") | (header_value(content, "kind") == "decision")


def frozen_notes(head: DataFrame) -> DataFrame:
    return head.filter(F.col("path").endswith(".md") & is_frozen(F.col("content")))


def unapproved_edits(head: DataFrame, work: DataFrame, approvals: DataFrame) -> DataFrame:
    """(source, path) of frozen notes whose working copy differs without an approval of that file and one line."""
    changed = frozen_notes(head).alias("h").join(work.alias("w"), ["source", "path"]).filter(F.col("h.content") != F.col("w.content")).select("source", "path")
    good = approvals.filter((F.trim("reason") != "") & ~F.col("reason").rlike(r"[\x00-\x1F\x7F]"))
    return changed.join(good.select("source", "path"), ["source", "path"], "left_anti")


def parse_ledger(lines: DataFrame) -> DataFrame:
    """lines(source, line, value) -> the ten fields beside source, line and value."""
    return lines.withColumn("r", F.from_json("value", LEDGER)).select("source", "line", "value", "r.*")


def _safe(path: Column) -> Column:
    return ~F.coalesce(path, F.lit("")).rlike(r"(^|/)(\.{0,2})(/|$)|\\|[\x00-\x1F\x7F]")


def ledger_violations(lines: DataFrame) -> DataFrame:
    """(source, line, code, message): every way a record can be wrong."""
    r = parse_ledger(lines).withColumn("keys", F.json_object_keys("value"))
    want = F.array(*map(F.lit, LEDGER_COLUMNS))
    same = (F.col("old_identity") == F.col("new_identity")) & (F.col("old_path") == F.col("new_path"))
    full = F.forall(F.array(*LEDGER_COLUMNS), lambda x: x.isNotNull())
    rules = F.array(
        diagnostic("LEDGER-FIELDS", None, "record must have exactly the ten fields", ~F.coalesce((F.col("keys") == want) & full, F.lit(False))),
        diagnostic("LEDGER-SCHEMA", "schema", "schema is not known", F.col("schema") != SCHEMA),
        diagnostic("LEDGER-OPERATION", "operation", "operation must be relocate or amend", ~F.col("operation").isin("relocate", "amend")),
        diagnostic("LEDGER-OID", "head_oid", "head must be 40 or 64 lower-case hex digits", ~F.col("head_oid").rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")),
        diagnostic("LEDGER-DIGEST", "canonical_git_blob_sha256", "digest must be 64 lower-case hex digits", ~F.col("canonical_git_blob_sha256").rlike(r"^[0-9a-f]{64}$")),
        diagnostic("LEDGER-PATH", "old_path", "paths must be safe relative paths", ~_safe(F.col("old_path")) | ~_safe(F.col("new_path"))),
        diagnostic("LEDGER-AMEND", "new_path", "amend keeps identity and path", (F.col("operation") == "amend") & ~same),
        diagnostic("LEDGER-REASON", "reason", "reason must be one non-empty line", (F.trim("reason") == "") | F.col("reason").rlike(r"[\x00-\x1F\x7F]")),
        diagnostic("LEDGER-CANONICAL", None, "line is not in canonical form", F.col("value") != F.to_json(F.struct(*LEDGER_COLUMNS))),
    )
    return r.select("source", "line", F.inline(only_hits(rules))).select("source", "line", "code", "message")


def new_ledger_lines(head: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(violations, new records) of ledgers(source, line, value): the staged ledger must be HEAD's plus at least one."""
    both = head.select("source", "line", F.col("value").alias("old")).join(staged.select("source", "line", F.col("value").alias("new")), ["source", "line"], "full")
    changed = both.filter(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select("source", "line", F.lit("rewritten").alias("problem"))
    added = both.filter("old is null").select("source", "line", F.col("new").alias("value"))
    idle = staged.select("source").distinct().join(added.select("source").distinct(), "source", "left_anti").select("source", F.lit(None).cast(dict(staged.dtypes)["line"]).alias("line"), F.lit("nothing added").alias("problem"))
    return changed.unionByName(idle), added


def staged_findings(changes: DataFrame, head: DataFrame, staged: DataFrame, ledger: DataFrame, head_oid: DataFrame) -> DataFrame:
    """(source, old_path, status, problem): changes of frozen notes that no ledger record covers.

    Deletes and renames need a relocate record of that path, HEAD and committed blob, whose target is staged with the
    same blob, or isn't staged in this source (a move to another one, which ``unpaired_records`` checks); edits need an amend record of that path, HEAD and staged blob; any other status is an error."""
    frozen = frozen_notes(head).select("source", F.col("path").alias("old_path"), blob_sha256(F.col("content")).alias("old_blob"))
    blobs = staged.select("source", F.col("path").alias("new_path"), blob_sha256(F.col("content")).alias("new_blob"))
    hit = changes.select("source", "status", "old_path").join(frozen, ["source", "old_path"])
    records = ledger.join(head_oid.select(F.col("source"), F.col("oid").alias("head_oid")), ["source", "head_oid"])
    moved = records.filter("operation = 'relocate'").join(blobs, ["source", "new_path"], "left").filter(F.col("new_blob").isNull() | (F.col("new_blob") == F.col("canonical_git_blob_sha256")))
    moved = moved.select("source", "old_path", F.col("canonical_git_blob_sha256").alias("old_blob")).distinct()
    amended = records.filter("operation = 'amend'").join(blobs, ["source", "new_path"]).filter(F.col("new_blob") == F.col("canonical_git_blob_sha256")).select("source", "old_path").distinct()
    gone = hit.filter(F.col("status").rlike("^[DR]")).join(moved, ["source", "old_path", "old_blob"], "left_anti").withColumn("problem", F.lit("frozen note moved or deleted without a record"))
    edit = hit.filter("status = 'M'").join(amended, ["source", "old_path"], "left_anti").withColumn("problem", F.lit("frozen note edited without a record"))
    odd = hit.filter(~F.col("status").rlike("^[DR]|^M$")).withColumn("problem", F.lit("change of a frozen note is not allowed"))
    return gone.select("source", "old_path", "status", "problem").unionByName(edit.select("source", "old_path", "status", "problem")).unionByName(odd.select("source", "old_path", "status", "problem"))


def unused_records(ledger: DataFrame, changes: DataFrame, staged: DataFrame, head: DataFrame) -> DataFrame:
    """New records that no staged change uses: a relocate needs its old path gone and its target added with the
    recorded blob, an amend an edit of a frozen note."""
    blobs = staged.select("source", F.col("path").alias("new_path"), blob_sha256(F.col("content")).alias("canonical_git_blob_sha256"))
    gone = changes.filter(F.col("status").rlike("^[DR]")).select("source", "old_path").distinct()
    added = changes.select("source", F.when(F.col("status") == "A", F.col("old_path")).when(F.col("status").startswith("R"), F.col("new_path")).alias("new_path")).filter("new_path is not null").distinct()
    named = ledger.filter(F.split_part("new_identity", F.lit(":"), F.lit(3)) == nfc(stem(F.col("new_path"))))
    moved = named.filter("operation = 'relocate'").join(gone, ["source", "old_path"], "left_semi").join(added, ["source", "new_path"], "left_semi").join(blobs, ["source", "new_path", "canonical_git_blob_sha256"], "left_semi")
    frozen = frozen_notes(head).select("source", F.col("path").alias("old_path"))
    edited = changes.filter("status = 'M'").select("source", "old_path").distinct()
    amended = ledger.filter("operation = 'amend'").join(edited, ["source", "old_path"], "left_semi").join(frozen, ["source", "old_path"], "left_semi")
    used = moved.select("source", *LEDGER_COLUMNS).unionByName(amended.select("source", *LEDGER_COLUMNS))
    return ledger.select("source", *LEDGER_COLUMNS).join(used, ["source", *LEDGER_COLUMNS], "left_anti")


PAIRED = ["old_identity", "new_identity", "old_path", "new_path", "canonical_git_blob_sha256", "reason"]


def unpaired_records(source_ledger: DataFrame, target_ledger: DataFrame, target_oid: DataFrame | None = None, target_staged: DataFrame | None = None) -> DataFrame:
    """Moves between sources: records of one side without an equal one (in six fields) on the other, with ``side``.

    With target_oid(source, oid) also target records of another commit (``target head``), with target_staged(source,
    path, content) those whose new path isn't staged with the recorded blob (``target blob``)."""
    a = source_ledger.select(*PAIRED).distinct()
    b = target_ledger.select(*PAIRED).distinct()
    out = a.join(b, PAIRED, "left_anti").withColumn("side", F.lit("source")).unionByName(b.join(a, PAIRED, "left_anti").withColumn("side", F.lit("target")))
    if target_oid is not None:
        at_head = target_ledger.join(target_oid.select("source", F.col("oid").alias("head_oid")), ["source", "head_oid"], "left_anti")
        out = out.unionByName(at_head.select(*PAIRED).distinct().withColumn("side", F.lit("target head")))
    if target_staged is not None:
        blobs = target_staged.select("source", F.col("path").alias("new_path"), blob_sha256(F.col("content")).alias("canonical_git_blob_sha256"))
        unlike = target_ledger.join(blobs, ["source", "new_path", "canonical_git_blob_sha256"], "left_anti")
        out = out.unionByName(unlike.select(*PAIRED).distinct().withColumn("side", F.lit("target blob")))
    return out


def plan_moves(moves: DataFrame, notes: DataFrame, domains: DataFrame, head: DataFrame) -> DataFrame:
    """moves(source, path, target) with new_source, new_domain, new_slug, new_path, new_identity, problems and ok;
    ``ok`` holds for the whole batch or for none of it. target is ``source:domain`` or ``source:domain:slug``.

    notes(source, path, identity, slug, is_domain_index, content)."""
    t = F.split("target", ":")
    part = lambda i: F.get(t, F.lit(i))
    m = moves.select("*", part(0).alias("new_source"), F.coalesce(part(1), F.lit("")).alias("new_domain"), part(2).alias("asked"), F.size(t).alias("parts"))
    own = notes.select("source", "path", "slug", "identity", "is_domain_index", F.col("content").alias("now"))
    base = head.select("source", "path", F.col("content").alias("committed"))
    m = m.join(own, ["source", "path"], "left").join(base, ["source", "path"], "left")
    place = domains.select(F.col("source").alias("new_source"), F.col("domain").alias("new_domain"), F.col("dir").alias("new_dir"))
    m = m.join(place, ["new_source", "new_domain"], "left").withColumn("new_slug", F.coalesce("asked", "slug"))
    m = m.withColumns({"new_path": F.concat(F.col("new_dir"), F.lit("/"), "new_slug", F.lit(".md")), "new_identity": F.concat_ws(":", "new_source", "new_domain", nfc(F.col("new_slug")))})
    taken = notes.select(F.col("source").alias("new_source"), F.col("path").alias("new_path")).distinct().withColumn("taken", F.lit(True))
    m = m.join(taken, ["new_source", "new_path"], "left").withColumn("key", fold(F.col("new_identity")))
    keys = notes.select(fold(F.col("identity")).alias("key"), F.col("identity").alias("other"))
    clash = m.select("key", F.col("identity").alias("self")).distinct().join(keys, "key").filter(~F.col("other").eqNullSafe(F.col("self"))).select("key").distinct().withColumn("clash", F.lit(True))
    twice = F.count("*").over(Window.partitionBy("key")) > 1
    m = m.join(clash, "key", "left").withColumn("twice", twice)
    frozen = is_frozen(F.coalesce("committed", F.lit("")))
    problem = lambda text, when: F.when(F.coalesce(when, F.lit(False)), F.lit(text))
    problems = F.array_compact(
        F.array(
            problem("target is not source:domain or source:domain:slug", ~F.col("parts").isin(2, 3)),
            problem("note is not known", F.col("identity").isNull()),
            problem("index notes don't move", F.col("is_domain_index")),
            problem("target domain does not exist", F.col("new_dir").isNull()),
            problem("target is the note itself", (F.col("new_source") == F.col("source")) & (F.col("new_path") == F.col("path"))),
            problem("target path is taken", F.col("taken") & ~((F.col("new_source") == F.col("source")) & (F.col("new_path") == F.col("path")))),
            problem("note is not committed", F.col("identity").isNotNull() & F.col("committed").isNull()),
            problem("frozen note differs from its commit", frozen & (F.col("now") != F.col("committed"))),
            problem("identity collides at the target", F.coalesce("clash", F.lit(False)) | F.col("twice")),
        )
    )
    m = m.withColumn("problems", problems)
    bad = m.agg(F.coalesce(F.bool_or(F.size("problems") > 0), F.lit(False)).alias("bad"))
    return m.crossJoin(F.broadcast(bad)).select(*moves.columns, "new_source", "new_domain", "new_slug", "new_path", "new_identity", "problems", (~F.col("bad")).alias("ok"))  # one row


def plan_amends(replacements: DataFrame, head: DataFrame, approvals: DataFrame, invalid: DataFrame) -> DataFrame:
    """replacements(source, path, content, reason) with problems and the record's blob digest. invalid(source, path)
    names replacements with diagnostics."""
    base = head.select("source", "path", F.col("content").alias("committed"))
    ok = approvals.filter(F.trim("reason") != "").select("source", "path").distinct().withColumn("approved", F.lit(True))
    bad = invalid.select("source", "path").distinct().withColumn("invalid", F.lit(True))
    rows = replacements.join(base, ["source", "path"], "left").join(ok, ["source", "path"], "left").join(bad, ["source", "path"], "left")
    problem = lambda text, when: F.when(F.coalesce(when, F.lit(False)), F.lit(text))
    problems = F.array_compact(
        F.array(
            problem("note is not frozen in HEAD", F.col("committed").isNull() | ~is_frozen(F.coalesce("committed", F.lit("")))),
            problem("replacement is not a valid note", F.col("invalid")),
            problem("replacement equals the commit", F.col("content") == F.col("committed")),
            problem("reason must be one non-empty line", (F.trim(F.coalesce("reason", F.lit(""))) == "") | F.col("reason").rlike(r"[\x00-\x1F\x7F]")),
            problem("file has no approval", F.col("approved").isNull()),
        )
    )
    return rows.select(*replacements.columns, problems.alias("problems"), blob_sha256(F.col("content")).alias("canonical_git_blob_sha256"))


def read_ledger_v1(lines: DataFrame) -> DataFrame:
    """lines(source, line, value) of six tab-separated fields; shorter lines are skipped."""
    f = F.split("value", "\t")
    names = ("ts", "old_path", "new_path", "blob", "operation", "reason")
    return lines.filter(F.size(f) >= 6).select("source", "line", *(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))


def find_records_v1(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first record for each wanted (source, old_path, blob)."""
    rows = ledger.join(wanted.select("source", "old_path", "blob").distinct(), ["source", "old_path", "blob"], "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "old_path", "blob").orderBy("line"))).filter("n = 1").drop("n")
