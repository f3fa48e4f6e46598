"""A table of rows with unique keys, in buckets by a hash of the key, of which a change rewrites only those it touches.

A version is a manifest: per bucket, the write that holds it. A merge reads the buckets of the changed keys, leaves out
changes that change nothing, writes the buckets of the others anew and publishes a manifest that names them beside
the untouched ones, by compare-and-swap. A change of n rows writes n buckets at most; one that is merged again writes none.
Readers keep the version they opened.

The number of buckets is fixed when a table is made: choose it so that a bucket is some 100 MB. Keys must not be null and must
stand once, in a table and in the changes; anything else is refused before a row is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import pointer
from .storage import discard, materialise

BUCKET = "__bucket"


@dataclass(frozen=True)
class Version:
    """A published state: its number, the key, how many buckets, the schema, and the write that holds each bucket."""

    number: int
    key: str
    buckets: int
    schema: StructType
    held: dict[int, str]


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, buckets: int = 256) -> KeyedTable:
        """A new table of ``rows``; refused where one is there."""
        table = cls(rows.sparkSession, root)
        kept = materialise(rows, "keyed-rows")
        table._check(kept, key)
        first = Version(0, key, buckets, kept.schema, {})
        table._publish(first, table._write(kept.withColumn(BUCKET, table._bucket(first)), first))
        discard(kept)
        return table

    def version(self) -> Version:
        number, text = pointer.latest(self.spark, self.root)
        if text is None:
            raise ValueError(f"{self.root} has no version")
        state = json.loads(text)
        return Version(number, state["key"], state["buckets"], StructType.fromJson(state["schema"]), {int(b): w for b, w in state["held"].items()})

    def read(self, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        version = version or self.version()
        held = version.held if buckets is None else {b: version.held[b] for b in buckets if b in version.held}
        paths = [f"{self.root}/data/{write}/{BUCKET}={bucket}" for bucket, write in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def touched(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of the buckets that hold these keys (one column): all with a key among them, and neighbours."""
        version = version or self.version()
        column = keys.columns[0]
        wanted = keys.filter(F.col(column).isNotNull()).select(self._bucket(version, column).alias("b")).distinct().collect()  # one row a bucket at most
        return self.read(version, sorted(r.b for r in wanted))

    def merge(self, changes: DataFrame, gone: DataFrame | None = None, version: Version | None = None) -> tuple[Version, int]:
        """(version, buckets written) after ``changes`` replace or join the rows of their keys and the keys of ``gone`` are left
        out; a key in both stays. Based on ``version`` (the current one, if not given); another merge in between is a ``Conflict``."""
        version = version or self.version()
        key, bucket = version.key, self._bucket(version)
        changes = materialise(changes.select(version.schema.names).withColumn(BUCKET, bucket), "changes")
        self._check(changes, key)
        gone = changes.select(key).limit(0) if gone is None else gone.select(key).distinct().join(changes.select(key), key, "left_anti")
        gone = materialise(gone.withColumn(BUCKET, bucket), "gone")
        numbers = lambda *rows: {r[0] for d in rows for r in d.select(BUCKET).distinct().collect()}
        old = self.read(version, numbers(changes, gone))
        before = old.select(F.struct(*version.schema.names).alias("before"))
        same = F.col("before").isNotNull()
        for c in version.schema.names:
            same = same & F.col(c).eqNullSafe(F.col(f"before.{c}"))
        new = materialise(changes.join(before, changes[key] == before[f"before.{key}"], "left").filter(~same).select(*version.schema.names, BUCKET), "new-rows")
        lost = materialise(gone.join(old.select(key), key, "left_semi"), "lost-keys")
        discard(changes, gone)
        rewritten = numbers(new, lost)
        if not rewritten:
            discard(new, lost)
            return version, 0
        rest = self.read(version, rewritten).join(new.select(key).union(lost.select(key)), key, "left_anti").withColumn(BUCKET, bucket)
        held = self._write(rest.unionByName(new), version)
        published = self._publish(version, {**{b: w for b, w in version.held.items() if b not in rewritten}, **held})
        discard(new, lost)
        return published, len(rewritten)

    def expire(self, keep: int = 1) -> int:
        """Deletes written buckets that none of the last ``keep`` versions holds; gives their number. Not while a merge runs."""
        numbers = [n for n in pointer.names(self.spark, f"{self.root}/pointer") if n.isdigit()][-keep:]
        states = (json.loads(pointer.read_text(self.spark, f"{self.root}/pointer/{n}"))["held"] for n in numbers)
        live = {f"{write}/{BUCKET}={bucket}" for held in states for bucket, write in held.items()}
        written = {f"{write}/{b}" for write in pointer.names(self.spark, f"{self.root}/data") for b in pointer.names(self.spark, f"{self.root}/data/{write}") if b.startswith(BUCKET)}
        for spent in written - live:
            at, fs = pointer.located(self.spark, f"{self.root}/data/{spent}")
            fs.delete(at, True)
        return len(written - live)

    def _bucket(self, version: Version, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(column or version.key)), F.lit(version.buckets)).cast("int")

    def _check(self, rows: DataFrame, key: str) -> None:
        if not rows.filter(F.col(key).isNull()).isEmpty():
            raise ValueError(f"a {key} is null")
        if not rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"a {key} stands more than once")

    def _write(self, rows: DataFrame, version: Version) -> dict[int, str]:
        """Writes rows by bucket; gives the write of each bucket that has any."""
        name = uuid.uuid4().hex
        rows.select(*version.schema.names, BUCKET).repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.root}/data/{name}")
        made = (n.removeprefix(f"{BUCKET}=") for n in pointer.names(self.spark, f"{self.root}/data/{name}") if n.startswith(f"{BUCKET}="))
        return {int(b): name for b in made}

    def _publish(self, base: Version, held: dict[int, str]) -> Version:
        state = {"key": base.key, "buckets": base.buckets, "schema": json.loads(base.schema.json()), "held": {str(b): w for b, w in sorted(held.items())}}
        return Version(pointer.advance(self.spark, self.root, base.number, json.dumps(state)), base.key, base.buckets, base.schema, held)
