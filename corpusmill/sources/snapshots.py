"""Versioned snapshots of a table of documents: content-addressed, validated, published by a compare-and-swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pointer

CONTRACT = "corpus-generation-v2"
SHARDS = 256


def _row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def snapshot_id(docs: DataFrame, key: str = "identity", profile: str = "default") -> tuple[str, int]:
    """(id, rows): SHA-256 over the contract, the profile and the row hashes in order. Hashes are folded per range of
    their own first byte, so the driver sees at most 256 of them and no task all rows."""
    rows = docs.select(_row_hash(sorted(docs.columns)).alias("h"))
    shards = rows.groupBy(F.substring("h", 1, 2).alias("shard"), F.substring("h", 3, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    shards = shards.groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.sum("n").alias("n"))
    one = shards.agg(F.sha2(F.concat_ws("|", F.lit(CONTRACT), F.lit(profile), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "h"))), lambda x: x["h"]), "")), 256), F.coalesce(F.sum("n"), F.lit(0))).first()
    return one[0], one[1]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames over it, so readers see the old text or the new."""
    path_of, fs = _fs(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(path_of(part))
    out.write(bytearray(text.encode()))
    out.close()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path_of(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path_of(part), path_of(path), _overwrite(spark))


def _overwrite(spark: SparkSession):
    gateway = spark.sparkContext._gateway
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    array = gateway.new_array(option, 1)
    array[0] = option.OVERWRITE
    return array


def build(docs: DataFrame, root: str, key: str = "identity", profile: str = "default") -> str:
    """Writes a snapshot under ``generations/<id>`` unless it exists; returns its id."""
    spark = docs.sparkSession
    if not docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{key} stands more than once")
    name, rows = snapshot_id(docs, key, profile)
    at = f"{root}/generations/{name}"
    if pointer.read_text(spark, f"{at}/MANIFEST") is None:
        docs.write.mode("overwrite").parquet(f"{at}/rows")
        _write_text(spark, f"{at}/MANIFEST", json.dumps({"contract": CONTRACT, "id": name, "profile": profile, "key": key, "rows": rows}))
    return name


def validate(spark: SparkSession, root: str, name: str) -> dict:
    """Counts and hashes a snapshot again; raises where it differs from its manifest."""
    text = pointer.read_text(spark, f"{root}/generations/{name}/MANIFEST")
    if text is None:
        raise ValueError(f"snapshot {name} has no manifest")
    manifest = json.loads(text)
    got = snapshot_id(spark.read.parquet(f"{root}/generations/{name}/rows"), manifest["key"], manifest["profile"])
    if got != (name, manifest["rows"]) or manifest["id"] != name or manifest["contract"] != CONTRACT:
        raise ValueError(f"snapshot {name} does not match its manifest")
    return manifest


def published(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number of the publication, id of the current snapshot); (0, None) before the first."""
    return pointer.latest(spark, root)


def publish(spark: SparkSession, root: str, name: str, replaces: int | None = None) -> int:
    """Validates, then moves the pointer on from publication ``replaces`` (the one current at the call, if not given); a
    snapshot that fails leaves the old one current, and of two publishers that replace the same one the second gets a
    ``pointer.Conflict``. Gives the number of the new publication."""
    before = published(spark, root)[0] if replaces is None else replaces
    validate(spark, root, name)
    return pointer.advance(spark, root, before, name)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    name = published(spark, root)[1]
    return None if name is None else spark.read.parquet(f"{root}/generations/{name}/rows")
