"""Exact cosine search that leaves out cells of points which provably hold nothing better.

Points are indexed once: centres are fitted on a bounded sample, every point gets the cell of its nearest centre and its angle
to it, and every cell its number of points and its radius, the greatest of these angles. Angles obey the triangle
inequality, so no point of a cell is nearer to a query than the query's angle to the centre less the radius. A search
looks into the nearest cells first, until they hold ``SEED`` times k points; the k-th best angle found there bounds the
rest: only cells that may hold a point within it are looked into. Points stay where they are: tasks get, per cell, the
queries that look into it, so a cell of any size is as many tasks as its files.

How much is left out depends on the data: nothing where vectors stand nearly at right angles to each other, most where they
form clusters. ``Found.visited`` tells the share of all (query, point) pairs that were scored.

Defined cases: points without a vector are no candidates, as are those with an empty ``per_object``; zero vectors have no
angle, they are a cell that every query looks into, and a zero query looks into all cells; ties go by the keys; an empty
table gives no hits. Scores count to twelve digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialise
from .semantic import QUERY_BYTES, ROWS, TILE, candidates, found_rows, hit_schema, matrix_of, offer, query_blocks, running_best, unit

#: Vectors of the sample that centres are fitted on, cells at most, points to look at before the first bound, times k.
SAMPLE, MOST_CELLS, SEED = 1 << 14, 1024, 4
ROUNDS = 8
#: Room for rounding in angles.
SLACK = 1e-6
ZERO = -1


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fit_centres(points: DataFrame, keys: list[str], cells: int | None = None) -> np.ndarray:
    """Unit vectors of the centres: some rounds of moving them to the mean direction of their part of the sample. As many as the
    root of the points, if not given."""
    there = points.filter(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))
    cells = cells or max(1, min(MOST_CELLS, int(there.count() ** 0.5)))
    sample = there.orderBy(F.xxhash64(*keys), *keys).select("vector").limit(SAMPLE).collect()  # at most SAMPLE vectors
    if not sample:
        return np.zeros((0, 0))
    data = unit(np.array([r.vector for r in sample], np.float64))
    centres = data[:: max(1, len(data) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        near = (data @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        moved = np.linalg.norm(sums, axis=1) > 1e-12
        centres[moved] = unit(sums[moved])
    return centres


@dataclass
class Index:
    """Points with cell and angle, and per cell (numbers as in ``cell``): points, radius and centre."""

    points: DataFrame
    cell: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    centres: np.ndarray


def build_index(points: DataFrame, keys: list[str], cells: int | None = None) -> Index:
    centres = fit_centres(points, keys, cells)
    held = points.sparkSession.sparkContext.broadcast(centres)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", cell int, angle double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = held.value
        for batch in (whole.iloc[low : low + ROWS] for whole in batches for low in range(0, len(whole), ROWS)):
            batch = batch[batch["vector"].notna()]
            if not len(batch):
                continue
            vectors = np.array(batch["vector"].tolist(), np.float64)
            zero = ~vectors.any(1)
            cosines = unit(vectors) @ centres.T if len(centres) else np.zeros((len(batch), 1))
            yield batch.assign(cell=np.where(zero, ZERO, cosines.argmax(1)).astype(np.int32), angle=np.where(zero, np.pi, angles(cosines.max(1))))

    table = materialise(points.mapInPandas(run, schema), "cells")
    facts = table.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()  # one row a cell
    cell = np.array([r.cell for r in facts], np.int64)
    centre = centres[np.maximum(cell, 0)] if len(centres) else np.zeros((len(cell), 1))
    return Index(table, cell, np.array([r.n for r in facts], np.int64), np.array([r.radius for r in facts]), centre)


@dataclass
class Found:
    """hits(query_id, *keys, score, rank), and the share of (query, point) pairs that were scored."""

    hits: DataFrame
    visited: float


def _score(index: Index, names: pa.Array, matrix: np.ndarray, look: np.ndarray, k: int, keys: list[str], per_object: str | None, schema: str) -> DataFrame:
    """Scores of each query with the points of the cells that it looks into (a row of ``look``); a task's best k a query."""
    plan = {int(c): np.flatnonzero(look[:, j]).astype(np.int32) for j, c in enumerate(index.cell)}
    held = index.points.sparkSession.sparkContext.broadcast((names, matrix, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, plan = held.value
        top = running_best(k, keys, per_object)
        for batch in candidates(batches, keys, per_object):
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                asking = plan.get(c, ())
                if not len(asking):
                    continue
                points = batch.take(pa.array(np.flatnonzero(cell == c)))
                vectors = unit(matrix_of(points.column("vector")))
                step = max(1, TILE // len(vectors))
                for low in range(0, len(asking), step):
                    who = asking[low : low + step].astype(np.int64)
                    offer(top, who, np.round(matrix[who] @ vectors.T, 12), points, keys, per_object)
        yield from found_rows(top, names, keys)

    wanted = [int(c) for c, asked in plan.items() if len(asked)]
    return index.points.filter(F.col("cell").isin(wanted)).select(*keys, "vector", "cell").mapInArrow(run, schema)


def _cut(hits: DataFrame, k: int, keys: list[str], per_object: str | None) -> DataFrame:
    order = [F.desc("score"), *keys]
    if per_object:
        hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", per_object).orderBy(*order))).filter("n = 1").drop("n")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def pruned_top(query_vectors: DataFrame, index: Index, k: int, keys: list[str], per_object: str | None = None) -> Found:
    """What ``semantic.cosine_top`` gives, from the cells that can matter. Queries go in blocks of ``QUERY_BYTES``."""
    kind, schema, scored, pairs = dict(query_vectors.dtypes)["query_id"], hit_schema(query_vectors, index.points, keys), 0, 0
    out = index.points.limit(0).select(F.lit(None).cast(kind).alias("query_id"), *keys, F.lit(0.0).alias("score"))
    for block in query_blocks(query_vectors, 8 * max(1, index.centres.shape[1]) + 8 * max(1, len(index.cell)), QUERY_BYTES):
        rows = block.select("query_id", "vector").toArrow()  # at most QUERY_BYTES
        if not rows.num_rows:
            continue
        names = rows["query_id"].combine_chunks()
        matrix = unit(matrix_of(rows["vector"].combine_chunks()))
        free = (index.cell == ZERO)[None, :] | ~matrix.any(1)[:, None]  # where no bound holds
        apart = angles(matrix @ index.centres.T) if (index.cell != ZERO).any() else np.zeros((len(rows), len(index.cell)))
        order = np.argsort(np.where(index.cell == ZERO, -1.0, apart), 1, kind="stable")
        before = np.cumsum(index.size[order], 1) - index.size[order]
        seed = np.zeros(apart.shape, bool)
        np.put_along_axis(seed, order, before < SEED * k, 1)
        seed |= free
        first = materialise(_cut(_score(index, names, matrix, seed, k, keys, per_object, schema), k, keys, per_object).drop("rank"), "seed-hits")
        least = {r.query_id: r.score for r in first.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == k).collect()}
        reach = angles(np.array([least.get(name, -1.0) for name in names.to_pylist()]))
        rest = ~seed & (apart - index.radius[None, :] <= reach[:, None] + SLACK)
        out = out.unionByName(first).unionByName(_score(index, names, matrix, rest, k, keys, per_object, schema))
        scored, pairs = scored + int((seed | rest).astype(np.int64).dot(index.size).sum()), pairs + len(names) * int(index.size.sum())
    return Found(_cut(out, k, keys, per_object), scored / pairs if pairs else 0.0)
