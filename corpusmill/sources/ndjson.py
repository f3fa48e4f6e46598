"""Documents as newline-delimited JSON: lenient and validating readers, canonical and partitioned writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sha256_hex
from ..operators.compile import compiled_json
from ..operators.diagnostics import diagnostic, only_hits
from ..schemas import DOC_COLUMNS, DOC_SCHEMA, DOCS
from .storage import materialise


def read_docs(spark: SparkSession, path: str, schema_id: str = DOC_SCHEMA) -> DataFrame:
    """Documents of the wanted schema; corrupt lines are skipped, of an identity the first in file order stays."""
    rows = spark.read.schema(DOCS + ", _corrupt_record string").json(path).withColumn("file", F.input_file_name())
    rows = rows.filter(F.col("_corrupt_record").isNull() & (F.col("schema") == schema_id) & F.col("identity").isNotNull())
    first = F.row_number().over(Window.partitionBy("source", "identity").orderBy("file", "compiled_hash"))
    return rows.withColumn("n", first).filter("n = 1").select(DOC_COLUMNS)


def read_artifacts(spark: SparkSession, path: str, index_profile: str, artifact_schema: str) -> DataFrame:
    """Old artifact rows of one profile and schema: object_key, title, body, path; first per key."""
    schema = "object_key string, repo string, index_profile string, artifact_schema string, lexical_projection struct<title:string,body:string>, metadata_projection struct<title:string,path:string>"
    rows = spark.read.schema(schema).json(path).withColumn("file", F.input_file_name()).filter((F.col("index_profile") == index_profile) & (F.col("artifact_schema") == artifact_schema))
    title = F.coalesce(F.nullif("lexical_projection.title", F.lit("")), "metadata_projection.title", F.lit(""))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo", "object_key").orderBy("file"))).filter("n = 1")
    return rows.select("repo", "object_key", title.alias("title"), F.coalesce("lexical_projection.body", F.lit("")).alias("body"), F.coalesce("metadata_projection.path", F.lit("")).alias("path"))


def safe_path(path: Column) -> Column:
    """Relative, without empty, dot or dot-dot segments, backslashes or control characters."""
    return ~path.rlike(r"(^|/)(\.{0,2})(/|$)|\\|[\x00-\x1F]")


#: Lines that one task orders: a file of any size is checked by as many tasks as it has such blocks.
BLOCK_LINES = 1 << 16


def validate_lines(lines: DataFrame) -> DataFrame:
    """lines(file, line, value) -> (file, line, code, message): every way a canonical file can be wrong.

    What a line shows alone is found where it lies. For what lines show together only (file, line, identity) move:
    repeated identities by an aggregate and a join, order by blocks of lines, whose ends are compared in turn."""
    rows = lines.withColumn("d", F.from_json("value", DOCS, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    d = rows.select("file", "line", "value", "keys", "d.*")
    want = F.array(*map(F.lit, DOC_COLUMNS))
    required = [c for c in DOC_COLUMNS if c not in ("status", "commit_time")]
    absent = F.exists(F.array(*(F.col(c).isNull() for c in required)), lambda x: x)
    hash_ = r"^[0-9a-f]{64}$"
    canonical = F.to_json(F.struct(*DOC_COLUMNS), {"ignoreNullFields": "false"})
    alone = F.array(
        diagnostic("NOT-JSON", None, "line is not a JSON object", F.col("keys").isNull()),
        diagnostic("FIELDS", None, "fields differ from the schema", F.col("keys") != want),
        diagnostic("TYPE", None, "a field has the wrong type", (F.col("keys") == want) & absent),
        diagnostic("SCHEMA", "schema", "schema is not known", F.col("schema") != DOC_SCHEMA),
        diagnostic("PATH", "source_path", "source path is not a safe relative path", ~safe_path(F.col("source_path"))),
        diagnostic("HASH", "source_hash", "hash is not 64 lower-case hex digits", ~F.col("source_hash").rlike(hash_) | ~F.col("compiled_hash").rlike(hash_)),
        diagnostic("COMPILED-HASH", "compiled_hash", "compiled hash does not match", F.col("compiled_hash") != sha256_hex(compiled_json())),
        diagnostic("IDENTITY", "identity", "identity is not source:domain:slug", ~F.startswith("identity", F.concat("source", F.lit(":"), "domain", F.lit(":")))),
        diagnostic("CANONICAL", None, "line is not in canonical form", (F.col("keys") == want) & ~absent & (F.col("value") != canonical)),
    )
    found = d.select("file", "line", F.inline(only_hits(alone)))
    slim = materialise(d.select("file", "line", "identity"), "line-identities")
    again = slim.groupBy("file", "identity").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("file").alias("f"), F.col("identity").alias("i"))
    again = slim.join(again, (F.col("file") == F.col("f")) & F.col("identity").eqNullSafe(F.col("i"))).select("file", "line")
    together = F.array(diagnostic("DUPLICATE", "identity", "identity stands more than once", F.lit(True)))
    falling = F.array(diagnostic("ORDER", "identity", "identities are not ascending", F.lit(True)))
    found = found.unionByName(again.select("file", "line", F.inline(only_hits(together)))).unionByName(out_of_order(slim).select("file", "line", F.inline(only_hits(falling))))
    return found.select("file", "line", "code", "message")


def out_of_order(rows: DataFrame) -> DataFrame:
    """rows(file, line, identity) -> (file, line) of lines whose identity is less than that of the line before. Each block is
    ordered by itself; (last line, its identity) of a block goes to the one after it."""
    cut = rows.withColumn("block", F.floor((F.col("line") - 1) / BLOCK_LINES))
    ends = cut.groupBy("file", "block").agg(F.max_by("identity", "line").alias("end"))
    before = Window.partitionBy("file").orderBy("block")  # one row a block
    ends = ends.select("file", "block", F.lag("end").over(before).alias("end"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    linked = cut.join(ends, ["file", "block"])
    last = F.when(F.row_number().over(inside) == 1, F.col("end")).otherwise(F.lag("identity").over(inside))
    return linked.withColumn("last", last).filter(F.col("last") > F.col("identity")).select("file", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered in each file, which no task need read whole."""
    return number_lines(spark.read.text(path).withColumn("file", F.input_file_name()), ["file"]).select("file", "line", "value")


def number_lines(rows: DataFrame, key: list[str]) -> DataFrame:
    """A scan of text files with ``line``, from 1 in each file; ``key`` are columns that tell files apart. Every split of a file
    counts its lines, and sums of the counts of the splits before it number them."""
    rows = rows.withColumns({"split": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()})
    counts = rows.groupBy(*key, "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy(*key).orderBy("split")  # one row a split
    counts = counts.select(*key, "split", (F.sum("n").over(upto) - F.col("n") - F.col("first") + 1).alias("shift"))
    return rows.join(counts, [*key, "split"]).withColumn("line", F.col("at") + F.col("shift")).drop("split", "at", "shift")


def write_canonical(docs: DataFrame, path: str) -> None:
    """Canonical lines, in order of identity over range-partitioned files; a repeated identity is an error."""
    from ..operators.compile import duplicate_identities

    if not duplicate_identities(docs).isEmpty():
        raise ValueError("an identity stands more than once")
    docs.orderBy("identity").select(F.to_json(F.struct(*DOC_COLUMNS), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_by_source(docs: DataFrame, path: str) -> None:
    """Parquet by source; only the sources at hand are replaced."""
    docs.write.partitionBy("source").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
