"""Bounded BM25 against all scores, ranked."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bounded, lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"s{i % 3}", f"s{i % 3}:d{i % 2}:{i}", text(2), text(40) if i % 17 else None, ["d", f"d/e{i % 2}"], ["spec", "note"][i % 2], None if i % 4 else "frozen", ["Red", "blue"][: i % 3]) for i in range(120)]
    rows += [("s0", "s0:d0:tie1", "w1", "w2 w3", ["d"], "note", None, None), ("s0", "s0:d0:tie0", "w1", "w2 w3", ["d"], "note", None, None)]
    docs = spark.createDataFrame(rows, "source string, identity string, title string, body_text string, domain_prefixes array<string>, kind string, status string, keywords array<string>")
    docs = docs.withColumns({"description": F.lit("about"), "source_path": F.concat("identity", F.lit(".md"))}).repartition(5).cache()
    asked = [(i, text(5), None, [None, "/d/e1/", " "][i % 3], [None, "note"][i % 2], None, [None, None, "RED"][i % 3]) for i in range(25)] + [(90, None, None, None, None, None, None), (91, "zzz", None, None, None, None, None), (92, "w1 w1 w2", " s0 ", None, None, "frozen", None)]
    queries = spark.createDataFrame(asked, "query_id int, text string, source string, domain string, kind string, status string, tag string").cache()
    return docs, queries


def plain(hits, columns=("query_id", "source", "identity", "rank", "score")):
    return sorted(tuple(r[c] for c in columns) for r in hits.collect())


@pytest.mark.parametrize("profile", ["v1", "v2"])
@pytest.mark.parametrize("entries", [1 << 22, 200])
def test_best_equals_all_scores_cut(spark, corpus, profile, entries, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(bounded, "ENTRIES", entries)
    fields = lexical.lexical_fields(docs.withColumn("facets", bounded.facet_keys()), ["facets"])
    scored = lexical.bm25_scores(queries, lexical.token_lists(fields), profile).withColumn("score", F.round("score", 6)).cache()
    found = bounded.match(queries, fields)
    assert len(found.blocks) > 1 if entries == 200 else len(found.blocks) == 1
    assert plain(bounded.best(found, 7, profile, digits=6)) == plain(lexical.top_k(scored, 7))
    assert plain(bounded.best(found, 2, profile, per_source=True, digits=6)) == plain(lexical.top_k(scored, 2, ["source"]))
    needs = queries.withColumn("needs", bounded.facet_needs("domain", "kind", "status", "tag"))
    got = bounded.best(bounded.match(needs, fields), 5, profile, digits=6)
    assert plain(got) == plain(lexical.top_k(lexical.with_facets(scored, queries, docs), 5))
    needs = queries.withColumn("needs", bounded.facet_needs("source"))
    got = bounded.best(bounded.match(needs, fields), 5, profile, digits=6)
    assert plain(got) == plain(lexical.top_k(lexical.narrow(scored, queries), 5))


def test_ties_stay_in_order_across_cuts():
    top, n = bounded.Best(2, room=1000), 500
    for low in range(0, 20_000, n):
        i = np.arange(low, low + n)[::-1]
        top.add(i % 2, np.ones(n), pa.array(["s"] * n), pa.array([f"{x:06d}" for x in i]))
        assert sum(t.num_rows for t in top.held) <= 1000 + n
    got = top.cut().to_pydict()
    assert got["group"] == [0, 0, 1, 1] and got["identity"] == ["000000", "000002", "000001", "000003"]
    assert (top.reach(np.array([0, 1, 5])) == [1, 1, 0]).all()


def test_nothing_to_find(spark, corpus):
    docs, queries = corpus
    fields = lexical.lexical_fields(docs)
    assert bounded.best(bounded.match(queries.limit(0), fields), 3).collect() == []
    assert bounded.best(bounded.match(queries, fields.limit(0)), 3).collect() == []


def test_points_that_tie_are_cut_at_once(spark):
    """Copies and zero vectors: k rows a query leave a task, the first by key."""
    from corpusmill.operators import semantic

    points = spark.createDataFrame([(f"p{i:04d}", [1.0, 0.0] if i % 2 else [0.0, 0.0], i) for i in range(3000)] + [(None, [1.0, 0.0], 1)], "pid string, vector array<float>, n int").coalesce(1)
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(20)] + [(99, [0.0, 0.0])], "query_id int, vector array<float>")
    got = semantic.cosine_top(queries, points, 3, ["pid"])
    assert {(r.query_id, r.pid, r["rank"]) for r in got.collect() if r.query_id in (0, 99)} == {(0, None, 1), (0, "p0001", 2), (0, "p0003", 3), (99, None, 1), (99, "p0000", 2), (99, "p0001", 3)}
    assert got.count() == 63


def test_a_batch_is_worked_on_in_parts():
    """A batch as Spark gives it, of up to 64 MB, goes through in parts of bounded size that hold the same rows."""
    size = np.array([0, 5, 3, 100, 0, 1, 1, 1])
    assert list(bounded._ranges(size, 8)) == [(0, 3), (3, 4), (4, 8)]
    assert list(bounded._ranges(size, 1000, 3)) == [(0, 3), (3, 6), (6, 8)] and list(bounded._ranges(size[:0], 8)) == []
    lists = pa.array([["w"] * (bounded.TOKENS // 4)] * 10 + [None, []] + [["w"] * (2 * bounded.TOKENS)], pa.list_(pa.string()))
    batch = pa.record_batch({"id": pa.array(range(13)), "t0": lists, "t1": pa.array([["x"]] * 13)})
    parts = list(bounded._parts(iter([batch]), 2))
    assert pa.Table.from_batches(parts)["id"].to_pylist() == list(range(13))
    assert all(p.num_rows == 1 or sum(len(p.column(c).flatten()) for c in ("t0", "t1")) <= bounded.TOKENS for p in parts) and len(parts) > 3
