"""Whole-number clustering and the Merkle manifest against plain Python, with odd rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import centroids, merkle

N = 5


def cluster_by_force(rows, k, rounds, n=N):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in starts[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for i in range(len(middle)):
            of = [v for (_, v), m in zip(kept, mine) if m == i]
            if of:
                middle[i] = [sum(x) // len(of) for x in zip(*of)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in out)
    digest = lambda c: hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()
    return [(i, c, d, sum(e for _, b, e in out if b == c), total, digest(c)) for i, c, d in out]


@pytest.mark.parametrize("k", [3, 16, 200])
def test_clusters_equal_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(N)]) for i in range(90)]
    rows += [(7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), (100, [0.0] * N), (101, [0.0] * N), (102, [-0.015625] * N)]
    odd = [(200, None), (201, []), (202, [1.0] * (N - 1)), (203, [1.0] * N + [2.0]), (204, [None] * N), (205, [math.nan] + [0.0] * (N - 1)), (206, [math.inf] + [0.0] * (N - 1))]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, cluster int, v int").repartition(5)
    exact = [(i, [spark_float(x) for x in v]) for i, v in rows]
    got = sorted(map(tuple, centroids.cluster(table, k=k, components=N).collect()), key=repr)
    assert got == sorted(cluster_by_force(exact, k, 3), key=repr)


def spark_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_clusters_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).collect() == [] and centroids.cluster(none).columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), components=2)


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def grow_by_force(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def merkle_by_force(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (*r[:4], t))))
    lower = lambda t: None if t is None else "".join(c.lower() if c.isascii() else c for c in t)
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, lower(r[4]) if hit else r[4])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow_by_force([x[2] for x in sorted(by[s])]) for s in order}
    upper = grow_by_force([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (has, doc_id, own, altered) in enumerate(sorted(by[s])):
            proof, node, folded = "", own, altered
            for at, levels in ((i, trees[s]), (k, upper)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    before, after = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    proof, folded, at = proof + before + after, H(before + folded + after), at // 16
            out.append((doc_id if has else None, own, trees[s][-1][0], upper[-1][0], H(proof), folded, folded == upper[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, leaf string, pos long"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "": 2}, {"b": 700, None: 3, "é": 1}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_manifest_equals_force(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for j in range(n):
            i += 1
            rows.append((i * 7 % 1009, source, None if i % 5 == 0 else "en", None if i % 7 == 0 else i, [f"Text {i} Ä", "", None, "x" * 3000 + "A"][i % 4 if j else 0]))
    if len(sizes) == 3:
        rows += [rows[0], rows[0], (None, "b", None, None, None), (None, "b", None, None, "X"), (rows[5][0], *rows[6][1:])]
    docs = spark.createDataFrame([(*r, "k", "l", 1) for r in rows], SCHEMA).repartition(3)
    got = merkle.verify(merkle.build(docs, {"text": merkle.tampered_text()}))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(merkle_by_force(rows), key=repr)


def test_three_stages_and_no_rows(spark):
    docs = spark.range(66_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    manifest = merkle.build(docs)
    assert len(manifest.sources.stages) == 3
    want = grow_by_force([H(f"{len(str(i))}:{i}3:hot-1:1{len(str(i))}:{i}") for i in range(66_000)])
    assert manifest.root().first().digest == want[-1][0]
    assert merkle.verify(manifest).filter("verified").count() == 66_000
    assert merkle.verify(merkle.build(docs.limit(0))).collect() == []
