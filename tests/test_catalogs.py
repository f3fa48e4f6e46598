"""Catalogs as lines against catalogs as strings."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.order import numbered
from corpusmill.operators import catalogs, checks

S, E = checks.START, checks.END


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(4)
    rows = [("s", f"d{rng.randrange(3)}", f"p{i:03d}.md", f"about {i}", i % 9 == 0) for i in range(120)] + [("t", "d", "x.md", "é", False), ("only", "d", "INDEX.md", "", True)]
    return spark.createDataFrame([(s, d, f"{s}:{d}:{p}", p, text, index) for s, d, p, text, index in rows], "source string, domain string, identity string, path string, description string, is_domain_index boolean").repartition(4)


def joined(lines, value="line"):
    return {r[0]: "\n".join(x for _, x in sorted(r[1])) for r in lines.groupBy("source").agg(F.collect_list(F.struct("n", value))).collect()}


def test_lines_are_the_catalog(notes):
    assert joined(catalogs.catalog_lines(notes)) == {r.source: r.catalog for r in checks.catalog(notes).collect()}


def contents(catalog):
    """Index files, sound and not; the second of the same source in a place of its own."""
    good = catalog["s"]
    return [
        ("s", "a", f"top\n{good}\nend"), ("s", "b", f"{good}\r\nend"), ("s", "c", good.replace("\n", "\r\n")), ("s", "d", good.replace("about 5", "about five")), ("s", "e", good.replace("### d1\n", "")),
        ("s", "f", f"{S}\n{E}\n"), ("s", "g", "none"), ("s", "h", f"{E}\n{S}"), ("s", "i", f"{S}\n{S}\n{E}"), ("s", "j", f"x{S}\n{E}"), ("s", "k", good + "\n" + good), ("s", "l", ""), ("t", "a", f"é\r\n{S}\r\nold\n{E}\r\nz\n\n"),
        ("only", "a", f"{S}\n{E}"), ("only", "b", f"{S}\nx\n{E}"), ("gone", "a", f"1\n{S}\n{E}\n2"), ("t", "b", good),
    ]


def test_findings_are_the_same(spark, notes):
    strings = checks.catalog(notes)
    indexes = spark.createDataFrame(contents({r.source: r.catalog for r in strings.collect()}), "source string, path string, content string")
    want = checks.catalog_findings(indexes, strings)
    got = catalogs.line_findings(catalogs.split_lines(indexes), catalogs.catalog_lines(notes))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_replaced_regions_written_and_read(spark, notes, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "PART_LINES", 10)
    strings, rows = checks.catalog(notes), catalogs.catalog_lines(notes)
    indexes = spark.createDataFrame(contents({r.source: r.catalog for r in strings.collect()}), "source string, path string, content string")
    lines = catalogs.split_lines(indexes)
    plan = catalogs.plan_lines(lines)
    new, rejected = catalogs.apply_lines(plan, lines, rows)
    assert rejected.count() == 0
    catalogs.write_lines(new, f"{tmp_path}/out")
    back = catalogs.read_lines(spark, f"{tmp_path}/out").withColumn("source", F.concat_ws("/", "source", "path"))
    want = {f"{r.source}/{r.path}": r.new_content.replace(E + "\r\n", E + "\n") for r in checks.apply_catalog(checks.plan_catalog(indexes, strings), indexes).filter("path not in ('c', 'j')").collect()}
    got = joined(back, "value")
    got.pop("s/c")
    assert got == want
    assert catalogs.line_findings(catalogs.read_lines(spark, f"{tmp_path}/out"), rows).collect() == []
    # what surrounds a region has changed since the plan: the file stays
    later = lines.withColumn("value", F.when((F.col("path") == "a") & (F.col("value") == "end"), "END").otherwise(F.col("value")))
    new, rejected = catalogs.apply_lines(plan, later, rows)
    assert [tuple(r) for r in rejected.collect()] == [("s", "a")]
    same = lambda d: sorted(map(tuple, d.filter("source = 's' and path = 'a'").select("n", "value").collect()))
    assert same(new) == same(later)


def test_missing_parts_are_noticed(spark, notes, tmp_path):
    import shutil

    catalogs.write_lines(catalogs.catalog_lines(notes).select("source", F.lit("p").alias("path"), "n", F.col("line").alias("value")), f"{tmp_path}/out")
    shutil.rmtree(next((tmp_path / "out" / "parts").glob("of_source=t*")))
    with pytest.raises(ValueError, match="manifest"):
        catalogs.read_lines(spark, f"{tmp_path}/out")


def test_numbers_over_partitions(spark):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(300)) for _ in range(2000)]
    got = numbered(spark.createDataFrame(data, "k string, v int").repartition(6), ["k"], ["v"])
    seen = {}
    for r in got.collect():
        seen.setdefault(r.k, []).append((r.n, r.v))
    for k, rows in seen.items():
        assert [n for n, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and [v for _, v in sorted(rows)] == sorted(v for x, v in data if x == k)
