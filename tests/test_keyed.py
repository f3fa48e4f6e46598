"""Keyed tables, merges and the pointer that publishes them."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import semantic, sync
from corpusmill.sources import pointer, snapshots
from corpusmill.sources.keyed import KeyedTable
from corpusmill.streaming import incremental

SCHEMA = "k string, n int, v array<float>"


def rows(table):
    return {r.k: (r.n, r.v) for r in table.read().collect()}


def test_merges_write_only_what_they_touch(spark, tmp_path):
    rng = random.Random(3)
    want = {f"k{i}": (i, [float(i)]) for i in range(200)}
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], SCHEMA)
    table = KeyedTable.create(make(want), f"file://{tmp_path}/t", "k", 32)
    assert rows(table) == want
    opened = table.version()
    for _ in range(4):
        changes = {f"k{rng.randrange(260)}": (rng.randrange(9), None if rng.random() < 0.3 else [rng.random() > 0.5 and 1.0 or 2.0]) for _ in range(5)}
        gone = [(f"k{rng.randrange(260)}",) for _ in range(2)] + [(None,)]
        before = table.version().held
        version, written = table.merge(make(changes), spark.createDataFrame(gone, "k string"))
        want = {**{k: v for k, v in want.items() if (k,) not in gone}, **changes}
        assert rows(table) == want and written <= 7
        assert sum(version.held.get(b) != w for b, w in before.items()) <= written
        assert table.merge(make(changes), spark.createDataFrame(gone, "k string"))[1] == 0
        assert table.merge(make({}))[0].number == version.number
    assert table.read(opened).count() == 200
    assert table.expire() > 0 and rows(table) == want and table.expire() == 0
    everything = spark.createDataFrame([(k,) for k in want], "k string")
    assert table.merge(make({}), everything)[0].held == {} and rows(table) == {}
    assert table.merge(make({"x": (1, [])}))[1] == 1 and rows(table) == {"x": (1, [])}


def test_of_two_publishers_one_is_refused(spark, tmp_path):
    make = lambda *d: spark.createDataFrame(list(d), SCHEMA)
    table = KeyedTable.create(make(("a", 1, [])), f"file://{tmp_path}/t", "k", 4)
    seen = table.version()
    table.merge(make(("b", 2, [])), version=seen)
    with pytest.raises(pointer.Conflict):
        table.merge(make(("c", 3, [])), version=seen)
    assert set(rows(table)) == {"a", "b"}
    with pytest.raises(pointer.Conflict):
        KeyedTable.create(make(("z", 1, [])), table.root, "k", 4)
    root = f"file://{tmp_path}/s"
    first, second = (snapshots.build(spark.createDataFrame([("x", i)], "identity string, v int"), root) for i in (1, 2))
    assert snapshots.publish(spark, root, first, 0) == 1
    with pytest.raises(pointer.Conflict):
        snapshots.publish(spark, root, second, 0)
    assert snapshots.published(spark, root) == (1, first) and snapshots.publish(spark, root, second) == 2


def test_a_late_rename_is_refused(spark, tmp_path, monkeypatch):
    """Both publishers have read the same number: the file system lets one through."""
    root = f"file://{tmp_path}/p"
    assert pointer.advance(spark, root, 0, "one") == 1
    monkeypatch.setattr(pointer, "latest", lambda *a: (0, None))
    with pytest.raises(pointer.Conflict):
        pointer.advance(spark, root, 0, "other")
    monkeypatch.undo()
    assert pointer.latest(spark, root) == (1, "one")
    assert [n for n in pointer.names(spark, f"{root}/pointer") if n.startswith("_")] == []


@pytest.mark.parametrize("bad", [[("a", 1, []), ("a", 2, [])], [(None, 1, [])]])
def test_keys_that_repeat_or_are_null_are_refused(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        KeyedTable.create(spark.createDataFrame(bad, SCHEMA), f"file://{tmp_path}/t", "k")
    table = KeyedTable.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/t", "k")
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame(bad, SCHEMA))
    assert table.read().count() == 0 and table.version().number == 1


DOC = "identity string, domain string, domain_prefixes array<string>, kind string, kind_explicit boolean, status string, keywords array<string>, source string, source_path string, source_hash string, compiled_hash string, commit_time string, description string, body_text string, version int"


def test_a_stream_writes_buckets_of_its_changes(spark, tmp_path):
    def doc(i, body, version=1):
        return (f"s:d:{i}", "d", ["d"], "note", True, None, [], "s", f"d/{i}.md", "h", f"c{body}", None, "", body, version)

    empty = sync.desired_points(spark.createDataFrame([], DOC)).withColumn("vector", F.array().cast("array<float>")).select("point_id", "vector", *sync.PAYLOAD)
    table = KeyedTable.create(empty, f"file://{tmp_path}/points", "point_id", 16)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    run = lambda *docs: incremental.sync_batch(spark.createDataFrame(list(docs), DOC), table, embed, 1)
    assert run(*(doc(i, f"text {i}") for i in range(40)))[1] == 16 or table.read().count() == 40
    plan, written = run(doc(3, "text 3"), doc(5, "new", 1), doc(5, "newer", 2), doc(99, "text 7"))
    assert {r.identity: r.action for r in plan.collect()} == {"s:d:3": "unchanged", "s:d:5": "embed", "s:d:99": "rekey"} and written <= 2
    held = {r.identity: r.vector for r in table.read().collect()}
    assert len(held) == 41 and held["s:d:5"] == [5.0] and held["s:d:99"] == held["s:d:7"] == [6.0]
    assert run(doc(3, "text 3"), doc(5, "newer", 2), doc(99, "text 7"))[1] == 0
    assert calls.value == 41


def test_texts_are_neither_shuffled_for_a_plan_nor_written(spark, tmp_path):
    """The stand-in index is made without a shuffle; plans carry no text, and only rows to embed get theirs."""
    from corpusmill.plans import upkeep
    from corpusmill.sources import storage

    texts = [(i, f"text {i}", "en", f"src{i % 3}", 6) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(30).write.parquet(str(tmp_path / "documents.parquet"))
    points = upkeep.points(spark, str(tmp_path))
    assert "hashpartitioning" not in points._jdf.queryExecution().executedPlan().toString()
    assert points.count() == len({r.identity for r in points.collect()}) == sum(1 + (i % 4 == 0) + (i % 9 == 0) for i in range(60) if i % 10)
    asked = upkeep.wanted(spark, str(tmp_path))
    seen = []
    held = KeyedTable.create(points.select("point_id", "vector", *sync.PAYLOAD), storage.new_path(spark, "slim"), "point_id", 4)
    plan, written = sync.apply_to(held, asked, lambda rows: seen.append(rows) or semantic.embed_rows(rows, upkeep._embed, 2))
    assert "text" not in plan.columns and written > 0
    assert {(r.identity, r.text) for r in seen[0].select("identity", "text").collect()} == {(r.identity, r.text) for r in plan.filter("action = 'embed'").join(asked.select("identity", "text"), "identity").collect()} != set()


def test_other_texts_end_before_the_join(spark, tmp_path):
    """Where the rows to embed are too many to broadcast, texts of others are left out before they are shuffled; a text that is
    none, repeated or of a missing row changes nothing."""
    ids = [f"s:d:{i}" for i in range(500)]
    wanted = spark.createDataFrame([(i, None if n % 7 == 0 else f"text {n % 40}") for n, i in enumerate(ids)], "identity string, text string")
    plan = spark.createDataFrame([(i, "embed" if n % 5 == 0 else "unchanged") for n, i in enumerate(ids)] + [("s:d:gone", "embed"), (None, "embed")], "identity string, action string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sync.to_embed(plan, wanted)
        joins = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.identity, r.action, r.text or "") for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((i, "embed", "" if n % 7 == 0 else f"text {n % 40}") for n, i in enumerate(ids) if n % 5 == 0)
    assert joins.index("SortMergeJoin") < joins.index("BroadcastHashJoin")
