"""Paged services, steps that fail one by one, baselines of other fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluate, sync
from corpusmill.sources import isolated, paged


class Counted:
    """Pages of three rows; offsets are words. Failures are counted in files, as tasks run in other processes."""

    def __init__(self, folder, n, failures=0, only=None):
        self.folder, self.n, self.failures, self.only = folder, n, failures, only

    def following(self, offset):
        with open(f"{self.folder}/walked", "a") as f:
            f.write("w")
        i = 0 if offset is None else int(offset[1:]) + 1
        return f"p{i}" if i < self.size() else None

    def size(self):
        grown = f"{self.folder}/n"
        return int(open(grown).read()) if os.path.exists(grown) else self.n

    def fetch(self, offset):
        i = int(offset[1:])
        with open(f"{self.folder}/{offset}", "a") as f:
            f.write("x")
        if (self.only is None or i == self.only) and os.path.getsize(f"{self.folder}/{offset}") <= self.failures:
            raise OSError("no answer")
        return [(i, f"row {i}.{j}") for j in range(3)]


def test_pages_are_partitions_and_a_failing_one_is_tried_again(spark, tmp_path):
    service = Counted(str(tmp_path), 7, failures=2, only=4)
    rows = paged.read_pages(spark, service, "page int, text string", attempts=3, wait_seconds=0)
    assert rows.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, rows.collect())) == [(i, f"row {i}.{j}") for i in range(7) for j in range(3)]
    assert os.path.getsize(tmp_path / "p4") == 3 and os.path.getsize(tmp_path / "p5") == 1
    assert paged.read_pages(spark, service, "page int, text string", pages_per_task=3).rdd.getNumPartitions() == 3
    assert paged.read_pages(spark, Counted(str(tmp_path), 0), "page int, text string").count() == 0


def test_a_page_that_never_comes_fails_the_read(spark, tmp_path):
    service = Counted(str(tmp_path), 3, failures=99, only=1)
    with pytest.raises(Exception, match="page 'p1' failed 2 times"):
        paged.read_pages(spark, service, "page int, text string", attempts=2, wait_seconds=0).count()


def test_a_service_that_runs_in_circles_is_refused():
    class Circle:
        def following(self, offset):
            return "a" if offset != "a" else "b" if offset is None else "a"

    with pytest.raises(ValueError, match="follows itself"):
        paged.walk(Circle(), None)


def test_a_stream_takes_each_page_once(spark, tmp_path):
    service, out = Counted(str(tmp_path), 5), tmp_path / "out"

    def drain():
        stream = paged.read_pages(spark, service, "page int, text string", stream=True, pages_per_trigger=2)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start(str(out)).awaitTermination()
        return sorted(r.page for r in spark.read.parquet(str(out)).groupBy("page").count().filter("count = 3").collect())

    assert drain() == [0, 1] and drain() == [0, 1, 2, 3] and drain() == [0, 1, 2, 3, 4]
    (tmp_path / "n").write_text("7")
    assert drain() == [0, 1, 2, 3, 4, 5, 6] and spark.read.parquet(str(out)).count() == 21


def test_one_source_fails_and_the_others_stay(spark, tmp_path):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "n int, text string")
    good.write.parquet(str(tmp_path / "ok"))
    os.makedirs(tmp_path / "bad")
    (tmp_path / "bad" / "part.parquet").write_bytes(b"PAR1 no table")

    @F.udf("string")
    def broken(x):
        raise ArithmeticError("in a task")

    steps = {
        "ok": lambda: spark.read.parquet(str(tmp_path / "ok")),
        "corrupt": lambda: spark.read.schema("n int, text string").parquet(str(tmp_path / "bad")),
        "absent": lambda: spark.read.parquet(str(tmp_path / "nowhere")),
        "task": lambda: good.withColumn("text", broken("text")),
        "schema": lambda: good.drop("n"),
        "empty": lambda: good.limit(0),
    }
    rows, failures = isolated.run_isolated(spark, "read", steps, "n int, text string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]
    got = {r.source: r for r in failures.collect()}
    assert set(got) == {"corrupt", "absent", "task", "schema"} and all(r.step == "read" and 0 < len(r.error) <= isolated.ERROR_CHARS for r in got.values())
    rows, failures = isolated.run_isolated(spark, "read", {}, "n int, text string")
    assert rows.count() == failures.count() == 0


def test_a_baseline_of_another_fixture_is_refused(spark):
    gold = spark.createDataFrame([("fx", f"q{i}", f"s:d:{i}", "t", "x") for i in range(3)], "fixture_id string, query string, gold_key string, qtype string, _slice string")
    found = spark.createDataFrame([("overall", 0.9), ("qtype:t", 0.8)], "slice string, gold_at_10 double")
    lanes = {"lexical": found, "hybrid": found}
    good = evaluate.make_baseline(gold, lanes)
    assert {r.slice: r.gold_at_10 for r in evaluate.baseline_for(good, gold, "hybrid").collect()} == {"overall": 0.9, "qtype:t": 0.8}
    codes = lambda b, g=gold: sorted(r.code for r in evaluate.baseline_violations(b, g).collect())
    assert codes(good) == []
    assert codes(good, gold.withColumn("query", F.upper("query"))) == ["BASELINE-HASH"]
    assert codes(good, gold.withColumn("fixture_id", F.lit("fy"))) == ["BASELINE-FIXTURE", "BASELINE-HASH"]
    assert codes(good.filter("lane = 'lexical'")) == ["BASELINE-LANE"]
    assert codes(good.limit(0)) == ["BASELINE-LANE"]
    assert codes(good.unionByName(good)) == ["BASELINE-SLICE"]
    assert codes(good.withColumn("gold_at_10", F.when(F.col("slice") == "overall", 0.5))) == ["BASELINE-VALUE"]
    with pytest.raises(ValueError, match="other gold rows"):
        evaluate.baseline_for(good, gold.limit(2), "lexical")


def test_note_index(spark):
    points = spark.createDataFrame([("s:d:1", "p"), ("s:d:1", None), ("loose", "q"), (None, "r"), ("t:d:2", None)], "identity string, source_path string")
    assert sorted(map(tuple, sync.note_index(points).collect())) == [("s", "s:d:1", "p"), ("t", "t:d:2", "")]


def test_a_source_of_any_size_is_more_than_one_task(spark, tmp_path, monkeypatch):
    """The stand-in fleet is dealt without a shuffle: a source of nine rows in ten is written, and read again, in parts."""
    from corpusmill.plans import options

    texts = [(i, f"text {i}", "en", "src3" if i % 10 == 0 else "src0", 6) for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(30).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(options, "new_path", lambda spark, label: str(tmp_path / label))
    rows, failures = options._broken_fleet(spark, str(tmp_path))
    files = [f.name for f in (tmp_path / "fleet" / "of=src0").glob("*.parquet")]
    assert len(files) > 1 and all(f.endswith(".zstd.parquet") for f in [*files, *rows.inputFiles()])
    assert sorted(r.identity for r in rows.collect()) == sorted(f"src0:en:{i}" for i in range(200) if i % 10 and i % 11)
    assert [(r.source, r.step) for r in failures.collect()] == [("src3", "read")]
