"""Clustering around centroids in whole numbers, by expressions that run in the JVM alone.

Components become integers (floor of ``scale`` times the component), so every distance and every update is exact and the
same on any cluster. One round is one pass: ``zip_with`` and ``aggregate`` give a vector's squared distance to each
centroid, a literal array; ``array_min`` over (distance, number) pairs takes the nearest, the smaller number among
equals; sums of columns, combined in each task before the shuffle, give the next centroids. Only ``k`` rows of sums
reach the driver, and only ``k`` literal arrays go out, whatever the number of vectors; a cluster that holds most of them is
still one partial row a task.

Defined cases: a vector that is null, has another number of components, or has one that is null, NaN or infinite
is left out; fewer than ``k`` vectors give as many centroids; no vector gives no row; repeated rows count each, and
among equal identifiers the lesser vector is the earlier start; a null identifier starts no centroid while others are
left; an empty centroid stays where it is; components beyond +-2**27 after scaling end the query with an error, as
their distances need not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise

COMPONENTS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1:"
#: Bound of a scaled component: 64 squared differences below it fit a long.
BOUND = 1 << 27


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors in whole numbers."""
    vector = F.col(vector_col).cast("array<double>")
    usable = (F.size(vector) == components) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = lambda x: F.when(F.abs(x * scale) < BOUND, F.floor(x * scale)).otherwise(F.raise_error("a component is too large for whole distances").cast("long"))
    return rows.filter(usable).select(F.col(id_col).alias("vec_id"), F.transform(vector, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The k vectors with the least hash of seed and identifier, in that order."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.orderBy(order.asc_nulls_last(), "v").select("v").limit(k).collect()]


def distance(vector: str, centroid: Sequence[int]) -> str:
    """The squared Euclidean distance of a column to a literal centroid, as SQL: its text is parsed once, where as many
    lambdas and literals made one by one would take the driver a second a round."""
    literal = ", ".join(f"{x}L" for x in centroid)
    return f"aggregate(zip_with({vector}, array({literal}), (a, b) -> (a - b) * (a - b)), 0L, (total, d) -> total + d)"


def nearest(vector: str, centroids: Sequence[Sequence[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid."""
    pairs = ", ".join(f"struct({distance(vector, c)} AS distance, {i} AS cluster)" for i, c in enumerate(centroids))
    return F.expr(f"array_min(array({pairs}))")


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid becomes the floor of its vectors' mean; those without vectors stay."""
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(len(centroids[0]))]
    found = vectors.groupBy(nearest("v", centroids)["cluster"].alias("cluster")).agg(F.count("*").alias("n"), *sums).collect()
    moved = {r.cluster: [r[f"s{i}"] // r.n for i in range(len(centroids[0]))] for r in found}
    return [moved.get(i, c) for i, c in enumerate(centroids)]


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> list[list[int]]:
    """The centroids after these rounds."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; none without centroids."""
    if not centroids:
        return vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return vectors.select("vec_id", nearest("v", centroids).alias("near")).select("vec_id", "near.cluster", "near.distance")


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = materialise(whole_vectors(rows, id_col, vector_col, components, scale), "whole-vectors")
    centroids = fit(vectors, k, rounds, seed)
    assigned = materialise(assign(vectors, centroids), "assigned")
    discard(vectors)
    spread = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(spread.get(i, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = F.array(*(F.struct(F.lit(total).cast("long").alias("total"), F.lit(digest).alias("digest")) for total, digest in facts or [(0, "")]))[F.col("cluster")]
    return assigned.select("vec_id", "cluster", "distance", known["total"].alias("cluster_inertia"), F.lit(sum(spread.values())).cast("long").alias("inertia"), known["digest"].alias("centroid_sha256"))
