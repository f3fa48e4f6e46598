"""Generated catalogs as ordered rows: of a source of any size no row is longer than a line.

A catalog is (source, n, line); an index file is (source, path, n, value), from ``split_lines`` or a reader of lines. Drift is
a join of the two by place, what surrounds a region is told by sums of line hashes, and a new index is its lines numbered
anew. ``write_lines`` writes them in parts, each a sorted file of at most ``PART_LINES`` lines, beside a manifest that gives
their order; ``checks`` has the same operators for files that are one string each, with the same findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..sources.ndjson import number_lines
from ..sources.storage import materialise
from .checks import END, START

PART_LINES = 1 << 18
FILE = ["source", "path"]


def catalog_lines(notes: DataFrame) -> DataFrame:
    """(source, n, line): the start marker, a heading per domain and a line per note that isn't an index, in order of domain
    and path, and the end marker."""
    rows = notes.filter(~F.col("is_domain_index"))
    entry = F.concat(F.lit("- ["), "identity", F.lit("]("), "path", F.lit(") — "), "description")
    place = lambda section, kind: [F.lit(section).alias("section"), F.col("domain") if section == 1 else F.lit("").alias("domain"), F.lit(kind).alias("kind")]
    entries = rows.select("source", *place(1, 1), "path", entry.alias("line"))
    heads = rows.select("source", "domain").distinct().select("source", *place(1, 0), F.lit("").alias("path"), F.concat(F.lit("### "), "domain").alias("line"))
    edges = [rows.select("source").distinct().select("source", *place(at, 0), F.lit("").alias("path"), F.lit(mark).alias("line")) for at, mark in ((0, START), (2, END))]
    every = entries.unionByName(heads).unionByName(edges[0]).unionByName(edges[1])
    return numbered(every, ["source"], ["section", "domain", "kind", "path", "line"]).select("source", "n", "line")


def split_lines(indexes: DataFrame) -> DataFrame:
    """indexes(source, path, content) -> (source, path, n, value)."""
    rows = indexes.select(*FILE, F.posexplode(F.split("content", "\n")).alias("at", "value"))
    return rows.select(*FILE, (F.col("at") + 1).cast("long").alias("n"), "value")


def _is(mark: str) -> Column:
    return F.col("value").isin(mark, mark + "\r")


def regions(lines: DataFrame) -> DataFrame:
    """(source, path, starts, ends, first, last): how often each marker stands in a file, and where first."""
    first = lambda mark: F.min(F.when(_is(mark), F.col("n")))
    return lines.groupBy(*FILE).agg(F.count_if(_is(START)).alias("starts"), F.count_if(_is(END)).alias("ends"), first(START).alias("first"), first(END).alias("last"))


_SOUND = "starts = 1 and ends = 1 and last > first"


def _expected(marks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source, path, k, line): the lines that each sound file should have; the markers alone for a source without notes."""
    sound = marks.filter(_SOUND).select(*FILE)
    none = sound.join(catalog.select("source").distinct(), "source", "left_anti")
    bare = none.select(*FILE, F.posexplode(F.array(F.lit(START), F.lit(END))).alias("at", "line")).select(*FILE, (F.col("at") + 1).cast("long").alias("k"), "line")
    return sound.join(catalog, "source").select(*FILE, F.col("n").alias("k"), "line").unionByName(bare)


def line_findings(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """What ``checks.catalog_findings`` finds, from lines: marker errors, or drift of the region between them."""
    marks = materialise(regions(lines), "regions")
    inside = lines.join(marks.filter(_SOUND), FILE).filter("n between first and last")
    value = F.when(F.col("n") == F.col("last"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    inside = inside.select(*FILE, (F.col("n") - F.col("first") + 1).alias("k"), value.alias("value"))
    unlike = inside.join(_expected(marks, catalog), [*FILE, "k"], "full").filter(~F.col("value").eqNullSafe(F.col("line"))).select(*FILE).distinct()
    message = (
        F.when((F.col("starts") == 0) | (F.col("ends") == 0), "human index markers are missing")
        .when((F.col("starts") > 1) | (F.col("ends") > 1), "human index markers must occur exactly once")
        .when(F.col("last") < F.col("first"), "human index end marker must follow start marker")
    )
    bad = marks.withColumn("message", message).filter("message is not null").select("source", F.lit("KBV2-HUMAN-INDEX-MARKER").alias("code"), "path", "message")
    drift = unlike.select("source", F.lit("KBV2-HUMAN-INDEX-DRIFT").alias("code"), "path", F.lit("human index generated catalog is out of date").alias("message"))
    return bad.unionByName(drift).select("source", "code", F.lit("error").alias("severity"), "path", F.lit(None).cast("string").alias("field"), "message")


def _digest(side: Column) -> Column:
    """Sum of the hashes of the (place, line) pairs on one side of a region, in any order: 60 bits of SHA-256 each."""
    hash_ = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "value"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count_if(side).cast("string"), F.coalesce(F.sum(F.when(side, hash_)), F.lit(0)).cast("string"))


def plan_lines(lines: DataFrame) -> DataFrame:
    """(source, path, first, last, before, after) of files whose markers are sound: where the region is, and digests of what
    surrounds it, each counted from the region."""
    marks = regions(lines).filter(_SOUND).select(*FILE, "first", "last")
    rows = lines.join(marks, FILE).withColumn("side", F.when(F.col("n") < F.col("first"), "before").when(F.col("n") > F.col("last"), "after"))
    rows = rows.withColumn("n", F.when(F.col("side") == "after", F.col("n") - F.col("last")).otherwise(F.col("n")))
    on = lambda side: F.coalesce(F.col("side") == side, F.lit(False))
    return rows.groupBy(*FILE, "first", "last").agg(_digest(on("before")).alias("before"), _digest(on("after")).alias("after"))


def apply_lines(plan: DataFrame, lines: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new lines, rejected files): regions replaced in the files of a plan. What surrounds a region must be as planned, else
    the file keeps its lines and is a row (source, path) of the second table."""
    now = plan_lines(lines).select(*FILE, "first", "last", F.col("before").alias("before_now"), F.col("after").alias("after_now"))
    checked = plan.select(*FILE, "before", "after").join(now, FILE, "left")
    checked = materialise(checked.withColumn("good", F.coalesce((F.col("before") == F.col("before_now")) & (F.col("after") == F.col("after_now")), F.lit(False))), "checked-regions")
    marks = checked.filter("good").select(*FILE, "first", "last", F.lit(1).alias("starts"), F.lit(1).alias("ends"))
    new = _expected(marks, catalog)
    size = new.groupBy(*FILE).agg(F.count("*").alias("size"))
    around = lines.join(marks.select(*FILE, "first", "last").join(size, FILE), FILE).filter("n < first or n > last")
    moved = F.when(F.col("n") > F.col("last"), F.col("n") - F.col("last") + F.col("first") - 1 + F.col("size")).otherwise(F.col("n"))
    inside = new.join(marks.select(*FILE, "first"), FILE).select(*FILE, (F.col("k") + F.col("first") - 1).alias("n"), F.col("line").alias("value"))
    rejected = checked.filter("not good").select(*FILE)
    kept = lines.join(rejected, FILE, "left_semi").select(*FILE, "n", "value")
    return around.select(*FILE, moved.alias("n"), "value").unionByName(inside).unionByName(kept), rejected


def write_lines(lines: DataFrame, root: str) -> None:
    """Writes files of lines in order: parts of ``PART_LINES`` lines under ``parts``, each written by one task, and a
    ``manifest`` (source, path, part, n_lines). A file is its parts in order; its last line ends with a line feed too."""
    rows = lines.withColumn("part", F.floor((F.col("n") - 1) / PART_LINES))
    ordered = rows.select(F.col("value"), *(F.col(c).alias(f"of_{c}") for c in FILE), "part", "n").repartition("of_source", "of_path", "part").sortWithinPartitions("of_source", "of_path", "part", "n")
    ordered.drop("n").write.partitionBy("of_source", "of_path", "part").text(f"{root}/parts", lineSep="\n")
    rows.groupBy(*FILE, "part").agg(F.count("*").alias("n_lines")).write.parquet(f"{root}/manifest")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(source, path, n, value) of files that ``write_lines`` wrote; raises where parts don't hold what the manifest says."""
    rows = spark.read.schema("value string, of_source string, of_path string, part long").text(f"{root}/parts", lineSep="\n")
    rows = number_lines(rows, ["of_source", "of_path", "part"]).select(F.col("of_source").alias("source"), F.col("of_path").alias("path"), "part", "line", "value")
    found = rows.groupBy(*FILE, "part").agg(F.count("*").alias("found"))
    unlike = spark.read.parquet(f"{root}/manifest").join(found, [*FILE, "part"], "full").filter(~F.col("n_lines").eqNullSafe(F.col("found")))
    if not unlike.isEmpty():
        raise ValueError(f"{root}: parts differ from the manifest")
    return rows.select(*FILE, (F.col("part") * PART_LINES + F.col("line")).alias("n"), "value")
