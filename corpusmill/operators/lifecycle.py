"""Capture of raw notes and promotion along the lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse

#: The lifecycle, in order.
STATUSES = ("unclassified", "raw", "derived", "canonical")
RAW_DIR = "000-raw"


def capture_line(ts: Column, text: Column) -> Column:
    """``- <timestamp> <text>`` with white space collapsed; null where the text is blank or the stamp not one line."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when((flat != "") & (ts != "") & ~ts.rlike(r"[\x00-\x1F\x7F]"), F.concat(F.lit("- "), ts, F.lit(" "), flat))


def slug(title: Column) -> Column:
    """Words of a title as a safe file name of at most 80 characters."""
    value = F.regexp_replace(collapse(title), r"(?U)[^\w\-.]+", "-")
    value = F.regexp_replace(value, r"\A[-._]+|[-._]+\z", "")
    return F.substring(F.when(value == "", "untitled").otherwise(value), 1, 80)


def plan_captures(inbox: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """inbox(source, ts timestamp, title, body, origin) -> (source, path, content, problem): distinct dated paths, numbered
    on collision by the first numbers that ``taken(source, path)`` leaves."""
    title, origin = collapse(F.coalesce("title", F.lit(""))), collapse(F.coalesce("origin", F.lit("")))
    rows = inbox.withColumns({"title": title, "origin": F.when(origin == "", "manual").otherwise(origin)})
    base = F.concat(F.lit(f"{RAW_DIR}/"), F.date_format("ts", "yyyy/MM/dd/HHmmss"), F.lit("-"), slug(F.col("title")))
    rows = rows.withColumn("base", base)
    stems = taken.select("source", F.regexp_replace("path", r"\.md\z", "").alias("base")).distinct() if taken is not None else rows.select("source", "base").limit(0)
    rows = rows.join(stems.withColumn("held", F.lit(True)), ["source", "base"], "left")
    place = F.row_number().over(Window.partitionBy("source", "base").orderBy("title", "body", "origin"))
    rows = rows.withColumn("i", place - F.when(F.col("held"), 0).otherwise(1))
    # numbers that would give the path of another title, or one that is taken, are left out
    numbered = r"\A(.+)-(\d{2}|[1-9]\d{2,17})\z"
    names = rows.select("source", "base").union(stems).distinct()
    names = names.select("source", F.regexp_extract("base", numbered, 1).alias("base"), F.expr(f"try_cast(regexp_extract(base, r'{numbered}', 2) as long)").alias("r")).filter("r >= 2")
    names = names.select("source", "base", (F.col("r") - F.row_number().over(Window.partitionBy("source", "base").orderBy("r"))).alias("i"), F.lit(1).alias("skip"))
    rows = rows.withColumn("skip", F.lit(0)).unionByName(names, allowMissingColumns=True)
    # before the i-th number there are the left out ones with fewer than i free numbers below them
    skipped = F.sum("skip").over(Window.partitionBy("source", "base").orderBy("i", F.desc("skip")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n", F.col("i") + 1 + skipped).filter("skip = 0")
    digits = F.col("n").cast("string")
    path = F.concat("base", F.when(F.col("i") > 0, F.concat(F.lit("-"), F.when(F.col("n") < 100, F.lpad(digits, 2, "0")).otherwise(digits))).otherwise(""), F.lit(".md"))
    quoted = lambda c: F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$").substr(6, 1 << 30)
    json_ = lambda c: F.regexp_replace(quoted(c), r"\}\z", "")
    content = F.concat(F.lit("---\nstatus: raw\ncaptured_at: "), json_(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")), F.lit("\nsource: "), json_(F.col("origin")), F.lit("\n---\n\n# "), "title", F.lit("\n\n"), F.trim(F.coalesce("body", F.lit(""))), F.lit("\n"))
    empty = F.col("title") == ""
    return rows.select("source", F.when(~empty, path).alias("path"), F.when(~empty, content).alias("content"), F.when(empty, "capture title cannot be empty").alias("problem"))


def _order(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in zip(STATUSES, range(len(STATUSES))) for x in pair))[status]


def valid_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def promotion_gate(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """requests(source, path, target_status, last_verified, evidence) against notes(source, path, status) with
    ``from_status``, ``problem`` (null: accepted) and ``updates`` (what to write)."""
    target = F.lower(F.trim("target_status"))
    rows = requests.join(notes.select("source", "path", F.lower(F.trim("status")).alias("from_status"), F.lit(True).alias("there")), ["source", "path"], "left").withColumn("to", target)
    facts = F.filter(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    verified, final = F.trim(F.coalesce("last_verified", F.lit(""))), F.col("to") == "canonical"
    problem = (
        F.when(~F.coalesce(F.col("to").isin(*STATUSES[1:]), F.lit(False)), "target status must be raw, derived, or canonical")
        .when(F.col("there").isNull(), "note path not found")
        .when(~F.coalesce(F.col("from_status").isin(*STATUSES), F.lit(False)), "source status must be explicitly declared")
        .when(_order(F.col("to")) != _order(F.col("from_status")) + 1, "invalid lifecycle transition")
        .when(final & ~F.coalesce(valid_date(verified), F.lit(False)), "canonical promotion requires last_verified=YYYY-MM-DD")
        .when(final & (F.size(facts) == 0), "canonical promotion requires at least one evidence item")
    )
    value = lambda scalar, many: F.struct(scalar.cast("string").alias("scalar"), many.cast("array<string>").alias("items"))
    status = F.create_map(F.lit("status"), value(F.col("to"), F.lit(None)))
    more = F.create_map(F.lit("last_verified"), value(verified, F.lit(None)), F.lit("evidence"), value(F.lit(None), facts))
    updates = F.when(final, F.map_concat(status, more)).otherwise(status)
    rows = rows.withColumn("problem", problem)
    return rows.select(*requests.columns, "from_status", "problem", F.when(F.col("problem").isNull(), updates).alias("updates"))
