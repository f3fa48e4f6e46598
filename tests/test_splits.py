"""Files larger than a split, and long notes."""

import json
import random
import time

import pytest

from corpusmill.operators import checks
from corpusmill.sources import ndjson


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(2), []
    for name, n in (("a", 700), ("b", 1), ("c", 0), ("d", 90)):
        lines = [f"{name}{i}" + "x" * rng.randrange(0, 60) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in lines))
        want += [(name, i + 1, x) for i, x in enumerate(lines)]
    rows = ndjson.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert sorted((r.file.rsplit("/", 1)[1][0], r.line, r.value) for r in rows.collect()) == sorted(want)


def test_order_and_repeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ndjson, "BLOCK_LINES", 7)
    rng = random.Random(5)
    rows, want = [], set()
    for file in "fgh":
        ids = [None if rng.random() < 0.1 else f"s:d:{max(0, i + rng.randrange(-2, 2)):03d}" for i in range(60)]
        rows += [(file, i + 1, json.dumps({"identity": x}) if x else "no json") for i, x in enumerate(ids)]
        want |= {(file, i + 1, "ORDER") for i in range(1, 60) if ids[i] and ids[i - 1] and ids[i] < ids[i - 1]}
        want |= {(file, i + 1, "DUPLICATE") for i in range(60) if ids.count(ids[i]) > 1}
    lines = spark.createDataFrame(rows, "file string, line long, value string").repartition(6)
    got = ndjson.validate_lines(lines).filter("code in ('ORDER', 'DUPLICATE')")
    assert {tuple(r)[:3] for r in got.collect()} == want
    assert ndjson.validate_lines(lines.limit(0)).collect() == []


def blocks(text):
    return checks.fenced(text, "mermaid")


def test_fences(spark):
    text = "a\n  ```mermaid x\ng1\r\ng2\n````\n~~~\n```mermaid\n~~~\n``` \tMermaid\n```\n~~~~mermaid\n~~~\n\t~~~~\n  ~~~~\n```mermaid"
    assert blocks(text) == [(3, "g1\ng2", True), (10, "", True), (12, "~~~\n\t~~~~", True), (16, "", False)]
    notes = spark.createDataFrame([("s", "p", text), ("s", "q", None), ("s", "r", "```text\n```"), ("s", "t", "")], "source string, path string, content string")
    assert [(r.path, r.line, r.code, r.closed) for r in checks.diagram_blocks(notes).collect()] == [("p", *b) for b in blocks(text)]


def test_a_long_block_takes_linear_time():
    began = time.time()
    assert len(blocks("```mermaid\n" + "x\n" * 300_000 + "```\n" + "```mermaid\n```\n" * 100_000)) == 100_001
    assert time.time() - began < 10
