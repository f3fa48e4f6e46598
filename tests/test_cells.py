"""Search by cells against all scores."""

import random

import pytest

from corpusmill.operators import cells, semantic


def clustered(n, dim, groups, noise, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [[x + rng.gauss(0, noise) for x in centres[0 if rng.random() < 0.4 else rng.randrange(groups)]] for _ in range(n)]


def plain(hits, key):
    return sorted((r.query_id, r["rank"], r[key], round(r.score, 9)) for r in hits.collect())


@pytest.mark.parametrize(("noise", "groups", "most"), [(0.05, 25, 0.25), (1.0, 5, 1.0)])
def test_cells_give_the_same_hits(spark, noise, groups, most):
    data = clustered(1500, 12, groups, noise, 3)
    rows = [(f"p{i:05d}", v, f"o{i % 40}" if i % 9 else None) for i, v in enumerate(data)]
    rows += [("zero1", [0.0] * 12, "z"), ("zero2", [0.0] * 12, ""), ("null", None, "n"), ("copy2", data[5], "c"), ("copy1", data[5], "c"), ("minus", [-x for x in data[0]], "m")]
    points = spark.createDataFrame(rows, "pid string, vector array<double>, object string").repartition(4)
    queries = spark.createDataFrame([(i, data[i * 31]) for i in range(40)] + [(90, [0.0] * 12), (91, [-x for x in data[7]]), (92, data[5])], "query_id int, vector array<double>")
    index = cells.build_index(points, ["pid"])
    got = cells.pruned_top(queries, index, 5, ["pid"])
    assert plain(got.hits, "pid") == plain(semantic.cosine_top(queries, points, 5, ["pid"]), "pid")
    assert 0 < got.visited <= most
    got = cells.pruned_top(queries, index, 4, ["object", "pid"], per_object="object")
    assert plain(got.hits, "pid") == plain(semantic.cosine_top(queries, points, 4, ["object", "pid"], per_object="object"), "pid")
    few = cells.pruned_top(queries, cells.build_index(points.filter("pid < 'p00003'"), ["pid"]), 7, ["pid"])
    assert few.hits.count() == 43 * min(7, points.filter("pid < 'p00003' and vector is not null").count())


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "pid string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>")
    assert cells.pruned_top(queries, cells.build_index(none, ["pid"]), 3, ["pid"]).hits.collect() == []
    zeros = spark.createDataFrame([("a", [0.0, 0.0])], "pid string, vector array<double>")
    assert [r.pid for r in cells.pruned_top(queries, cells.build_index(zeros, ["pid"]), 3, ["pid"]).hits.collect()] == ["a"]
    some = spark.createDataFrame([("a", [1.0, 0.0])], "pid string, vector array<double>")
    assert cells.pruned_top(queries.limit(0), cells.build_index(some, ["pid"]), 3, ["pid"]).hits.collect() == []


@pytest.mark.parametrize("per_object", [None, "label"])
def test_what_a_task_holds_is_bounded(per_object):
    """Many queries against many points, in cells of a few: rows held stay near queries x k, and equal all scores cut."""
    import numpy as np
    import pyarrow as pa

    rng, k, keys = np.random.default_rng(4), 3, ["label", "pid"]
    top, n_queries = semantic.running_best(k, keys, per_object), 200
    queries, points = semantic.unit(rng.integers(-2, 3, (n_queries, 4)).astype(float)), rng.integers(-2, 3, (6000, 4)).astype(float)
    points[7] = np.nan
    label = rng.integers(0, 50, len(points))
    whole = pa.record_batch({"label": pa.array(label), "pid": pa.array(rng.permutation(len(points))), "vector": pa.array(list(points), pa.list_(pa.float64()))})
    most = 0
    for batch in semantic.candidates(iter([whole]), keys, per_object):
        for low in range(0, batch.num_rows, 10):  # as cells of ten points
            part = batch.slice(low, 10)
            semantic.offer(top, np.arange(n_queries), np.round(queries @ semantic.unit(semantic.matrix_of(part.column("vector"))).T, 12), part, keys, per_object)
            most = max(most, sum(t.num_rows for t in top.held))
    assert most <= top.room + 10 * n_queries + n_queries * k
    got = top.cut().to_pylist()
    scores = np.round(queries @ semantic.unit(points).T, 12)
    for q in range(0, n_queries, 17):
        rows = sorted((-scores[q, i], label[i], whole["pid"][i].as_py()) for i in range(len(points)) if i != 7)
        if per_object:
            rows = _first_of_each(rows)
        assert [(r["k0"], r["k1"]) for r in got if r["group"] == q] == [(a, b) for _, a, b in rows[:k]]


def _first_of_each(rows):
    seen: dict = {}
    for r in rows:
        seen.setdefault(r[1], r)
    return list(seen.values())


def test_points_that_are_no_number_displace_none(spark):
    nan = float("nan")
    points = spark.createDataFrame([(f"p{i}", [1.0, float(i)], "a") for i in range(6)] + [(f"n{i}", [nan, 1.0], "b") for i in range(3)], "pid string, vector array<double>, object string").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r.pid for r in semantic.cosine_top(queries, points, 2, ["pid"]).orderBy("rank").collect()] == ["p0", "p1"]
    assert [r.pid for r in semantic.cosine_top(queries, points, 2, ["object", "pid"], per_object="object").collect()] == ["p0"]
    assert semantic.cosine_top(queries.limit(0), points, 2, ["pid"]).collect() == []
