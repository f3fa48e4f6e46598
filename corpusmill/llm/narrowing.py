"""Bounded maps of wanted values that spare shuffles of rows which no join will need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Bits of a map: at most BITS / 64 rows are broadcast, whatever the input.
BITS = 1 << 22


def _place(column: str) -> tuple[Column, Column]:
    """(word of the map, its bit) of a value."""
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    return F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def bit_map(wanted: DataFrame, column: str) -> DataFrame:
    """The map of ``wanted``'s values as a table of words with bits set."""
    word, bit = _place(column)
    return materialise(wanted.select(word.alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits")), "wanted-bits")


def perhaps_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be one of ``wanted``'s: all that are, and of others a share that grows with the number
    of wanted values (all of them, at worst, so a join must follow)."""
    word, bit = _place(column)
    held = rows.withColumn("__word", word).join(F.broadcast(bit_map(wanted, column)), "__word")
    return held.filter(bit.bitwiseAND(F.col("__bits")) != 0).select(rows.columns)


def split_among(rows: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose column may be one of ``wanted``'s, the others, of which none is)."""
    word, bit = _place(column)
    marked = rows.withColumn("__word", word).join(F.broadcast(bit_map(wanted, column)), "__word", "left")
    among = F.coalesce(bit.bitwiseAND(F.col("__bits")) != 0, F.lit(False))
    return marked.filter(among).select(rows.columns), marked.filter(~among).select(rows.columns)
