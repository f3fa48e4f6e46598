"""A numbered pointer that moves by compare-and-swap: of two publishers that read one number, one is refused.

Each state is a file under ``pointer``, named by its number; the next is renamed into place without overwriting, which the
file system does for one caller only. Readers take the greatest number, and see a whole state or the one before.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another publisher was first."""


def located(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; none if it isn't there."""
    at, fs = located(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing if it isn't there."""
    at, fs = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, text) of the current state; (0, None) before the first."""
    numbers = [n for n in names(spark, f"{root}/pointer") if n.isdigit()]
    return (int(numbers[-1]), read_text(spark, f"{root}/pointer/{numbers[-1]}")) if numbers else (0, None)


def advance(spark: SparkSession, root: str, after: int, text: str) -> int:
    """Makes ``text`` the state that follows number ``after``; raises ``Conflict`` where another follows it already."""
    if latest(spark, root)[0] != after:
        raise Conflict(f"{root} has moved on from {after}")
    target, part = f"{root}/pointer/{after + 1:012d}", f"{root}/pointer/_{uuid.uuid4().hex}"
    at, fs = located(spark, part)
    out = fs.create(at)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(rename, 1)
    none[0] = rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, located(spark, target)[0], none)
    except Py4JJavaError as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"{root} has moved on from {after}") from e
        raise
    return after + 1
