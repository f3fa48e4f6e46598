"""Retrieval evaluation: gold sets, ranks, metrics per slice, gates and A/B verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import GOLD
from .diagnostics import diagnostic, only_hits

CUTS = (1, 3, 5, 8, 10)
MARGIN = 0.01
FIELDS = [p.split()[0] for p in GOLD.split(", ")]


def read_gold(lines: DataFrame) -> DataFrame:
    """lines(line, value) -> line, value and the five fields."""
    return lines.withColumn("g", F.from_json("value", GOLD)).select("line", "value", F.json_object_keys("value").alias("keys"), "g.*")


def gold_violations(gold: DataFrame, sources: DataFrame) -> DataFrame:
    """(line, code, message) of gold rows (with keys) that break the format."""
    known = sources.select(F.col("source").alias("s")).distinct().withColumn("known", F.lit(True))
    rows = gold.withColumn("s", F.split_part("gold_key", F.lit(":"), F.lit(1))).join(known, "s", "left")
    first = gold.agg(F.min("fixture_id").alias("first"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    blank = F.exists(F.array(*FIELDS), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    rules = F.array(
        diagnostic("GOLD-FIELDS", None, "row must have exactly the five fields", ~F.coalesce(F.array_sort("keys") == F.array_sort(F.array(*map(F.lit, FIELDS))), F.lit(False))),
        diagnostic("GOLD-EMPTY", None, "fields must be non-empty strings", blank),
        diagnostic("GOLD-KEY", "gold_key", "gold key must be source:domain:slug", F.size(F.split("gold_key", ":")) != 3),
        diagnostic("GOLD-SOURCE", "gold_key", "source is not known", F.col("known").isNull()),
        diagnostic("GOLD-FIXTURE", "fixture_id", "all rows must share one fixture id", F.col("fixture_id") != F.col("first")),
    )
    return rows.select("line", F.inline(only_hits(rules))).select("line", "code", "message")


def fixture_hash(gold: DataFrame) -> DataFrame:
    """One row: SHA-256 over the rows' hashes in order (a gold set is small by nature; only 64 digits a row meet)."""
    row = F.sha2(F.to_json(F.struct(*sorted(FIELDS))), 256)
    return gold.select(row.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fixture_hash"), F.count("*").alias("n"))


def drift(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold keys that the corpus doesn't hold: any row fails a run."""
    return gold.select("gold_key").distinct().join(docs.select(F.col("identity").alias("gold_key")).distinct(), "gold_key", "left_anti")


def gold_ranks(gold: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """gold(query_id, gold_key, ..) with rank: that of the gold among the hits of its own source; 0 is a miss."""
    found = hits.filter(F.col("rank") <= depth).select("query_id", F.col("identity").alias("gold_key"), "rank")
    return gold.join(found, ["query_id", "gold_key"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def _metrics() -> list[Column]:
    at = lambda k: F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 4).alias(f"gold_at_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 4)
    return [F.count("*").alias("n"), F.count_if(F.col("rank") == 0).alias("no_hit"), *map(at, CUTS), mrr.alias("mrr")]


def metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(*_metrics())


def slices(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(slice, n, no_hit, gold_at_*, mrr): overall and every value of each column, in one pass of grouping sets."""
    sets = [[]] + [[c] for c in by]
    rows = ranks.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by)).agg(F.grouping_id(*by).alias("g"), *_metrics())
    everything = (1 << len(by)) - 1
    name = F.when(F.col("g") == everything, "overall")
    for i, c in enumerate(by):
        name = name.when(F.col("g") == everything - (1 << (len(by) - 1 - i)), F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    names = [c for c in rows.columns if c not in (*by, "g")]
    return rows.select(name.alias("slice"), *names)


def make_baseline(gold: DataFrame, lanes: dict[str, DataFrame]) -> DataFrame:
    """(fixture_id, fixture_hash, lane, slice, gold_at_10): the slices of each lane, bound to the gold set they were
    measured on."""
    rows = None
    for lane, found in lanes.items():
        one = found.select(F.lit(lane).alias("lane"), "slice", "gold_at_10")
        rows = one if rows is None else rows.unionByName(one)
    fixture = gold.agg(F.min("fixture_id").alias("fixture_id")).crossJoin(fixture_hash(gold).select("fixture_hash"))  # one row
    return rows.crossJoin(F.broadcast(fixture)).select("fixture_id", "fixture_hash", "lane", "slice", "gold_at_10")


def baseline_violations(baseline: DataFrame, gold: DataFrame, lanes: Sequence[str] = ("lexical", "hybrid")) -> DataFrame:
    """(code, message) of a baseline that must not judge runs on ``gold``: another fixture or hash, a lane without an
    overall slice, a slice that stands twice, a value outside 0 to 1. No row lets it in."""
    fixture = F.broadcast(gold.agg(F.min("fixture_id").alias("own_id")).crossJoin(fixture_hash(gold).select(F.col("fixture_hash").alias("own_hash"))))  # one row
    rows = baseline.crossJoin(fixture)
    whole = rows.groupBy("own_id", "own_hash").agg(
        F.count_if(~F.col("fixture_id").eqNullSafe(F.col("own_id"))).alias("other_id"),
        F.count_if(~F.col("fixture_hash").eqNullSafe(F.col("own_hash"))).alias("other_hash"),
        F.count_if(~F.coalesce(F.col("gold_at_10").between(0, 1), F.lit(False))).alias("bad"),
        F.collect_set(F.when((F.col("slice") == "overall") & F.col("lane").isin(*lanes), F.col("lane"))).alias("held"),
    )
    twice = baseline.groupBy("lane", "slice").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))  # one row
    facts = fixture.crossJoin(F.broadcast(twice)).join(F.broadcast(whole), ["own_id", "own_hash"], "left")
    missing = F.array_except(F.array(*map(F.lit, lanes)), F.coalesce("held", F.array().cast("array<string>")))
    rules = F.array(
        diagnostic("BASELINE-FIXTURE", None, "baseline is of another fixture", F.coalesce(F.col("other_id") > 0, F.lit(False))),
        diagnostic("BASELINE-HASH", None, "baseline was measured on other gold rows", F.coalesce(F.col("other_hash") > 0, F.lit(False))),
        diagnostic("BASELINE-LANE", None, "a lane has no overall value", F.size(missing) > 0),
        diagnostic("BASELINE-SLICE", None, "a slice stands more than once", F.col("twice") > 0),
        diagnostic("BASELINE-VALUE", None, "values must lie between 0 and 1", F.coalesce(F.col("bad") > 0, F.lit(False))),
    )
    return facts.select(F.inline(only_hits(rules))).select("code", "message")


def baseline_for(baseline: DataFrame, gold: DataFrame, lane: str, lanes: Sequence[str] = ("lexical", "hybrid")) -> DataFrame:
    """The lane's (slice, gold_at_10) for a gate; refuses a baseline that isn't of this gold set."""
    bad = baseline_violations(baseline, gold, lanes).collect()  # one row a rule at most
    if bad:
        raise ValueError("baseline refused: " + "; ".join(sorted(r.message for r in bad)))
    return baseline.filter(F.col("lane") == lane).select("slice", "gold_at_10")


def lexical_gate(current: DataFrame, baseline: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(slice, value, base, ok, rebaseline): at least the baseline less the margin; a baseline of zero asks for a new one."""
    rows = baseline.select("slice", F.col("gold_at_10").alias("base")).join(current.select("slice", F.col("gold_at_10").alias("value")), "slice", "left")
    return rows.select("slice", "value", "base", F.coalesce(F.col("value") >= F.col("base") - margin, F.lit(False)).alias("ok"), (F.col("base") == 0).alias("rebaseline"))


def hybrid_gate(hybrid: DataFrame, lexical: DataFrame, semantic: DataFrame, floor: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """(slice, value, best, floor, ok): at least the better lane and the floor, each less the margin."""
    v = lambda d, name: d.select("slice", F.col("gold_at_10").alias(name))
    rows = v(hybrid, "value").join(v(lexical, "lexical"), "slice", "left").join(v(semantic, "semantic"), "slice", "left").withColumn("best", F.greatest("lexical", "semantic"))
    rows = rows.join(v(floor, "floor"), "slice", "left") if floor is not None else rows.withColumn("floor", F.lit(None).cast("double"))
    ok = (F.col("value") >= F.col("best") - margin) & (F.col("floor").isNull() | (F.col("value") >= F.col("floor") - margin))
    return rows.select("slice", "value", "best", "floor", F.coalesce(ok, F.lit(False)).alias("ok"))


def gates_pass(gates: DataFrame) -> DataFrame:
    return gates.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


def ab_verdict(candidate: DataFrame, default: DataFrame, names: tuple[str, ...] = ("gold_at_10", "gold_at_5", "mrr"), margin: float = MARGIN) -> DataFrame:
    """One row: flip_on iff no metric of any slice falls by more than the margin and some metric rises."""
    pair = F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.col(f"c.{n}") - F.col(f"d.{n}"), 4).alias("delta")) for n in names))
    rows = candidate.alias("c").join(default.alias("d"), "slice").select("slice", F.inline(pair))
    return rows.agg(F.count_if(F.col("delta") < -margin).alias("regressed"), F.count_if(F.col("delta") > 0).alias("improved")).withColumn("flip_on", (F.col("regressed") == 0) & (F.col("improved") > 0))
