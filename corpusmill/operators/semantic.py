"""Exact cosine search of query vectors over points, and batch embedding.

Points stay where they are: a block of queries of checked size is broadcast, each task keeps its best per query, and
only those meet in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..llm.textbytes import release
from .bounded import Best

#: Bytes of query vectors that one pass broadcasts; more queries take more passes.
QUERY_BYTES = 64 << 20
#: Scores that a task has in memory at once.
TILE = 1 << 20
#: Points that are scored at once.
ROWS = 2048


def query_blocks(queries: DataFrame, bytes_each: int, most: int = QUERY_BYTES) -> list[DataFrame]:
    """Queries in parts of about ``most`` bytes."""
    blocks = max(1, -(-queries.count() * bytes_each // most))
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [queries]


def first_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of the k best points of each row of scores: those better than the k-th, and of those as good as it the
    first ones."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    better, equal = scores > least, scores == least
    room = k - better.sum(1, keepdims=True)
    return np.nonzero(better | (equal & (np.cumsum(equal, 1, dtype=np.int32) <= room)))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors as rows; all must have as many components. A null component is no number."""
    size = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(size) > 1:
        raise ValueError(f"vectors of {sorted(map(str, size))} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size[0] if size else 0)


def running_best(k: int, keys: list[str], per_object: str | None) -> Best:
    return Best(k, keys=[f"k{i}" for i in range(len(keys))], per=f"k{keys.index(per_object)}" if per_object else None, floor=-np.inf)


def candidates(batches: Iterator[pa.RecordBatch], keys: list[str], per_object: str | None) -> Iterator[pa.RecordBatch]:
    """Points with a vector, and with an object where only the best of each counts: ``ROWS`` at a time, those of an object
    together, else in the order of the keys, so that places decide between equal scores."""
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            good = pc.is_valid(batch.column("vector"))
            if per_object:
                value = batch.column(per_object)
                good = pc.and_(good, pc.is_valid(value) if not pa.types.is_string(value.type) else pc.fill_null(pc.not_equal(value, ""), False))
            batch = batch.filter(good)
            if batch.num_rows:
                order = [(c, "ascending") for c in dict.fromkeys([per_object, *keys] if per_object else keys)]
                yield batch.take(pc.sort_indices(batch.select([c for c, _ in order]), sort_keys=order, null_placement="at_start"))


def offer(top: Best, who: np.ndarray, scores: np.ndarray, points: pa.RecordBatch, keys: list[str], per_object: str | None) -> None:
    """The scores (a row for each query of ``who``, a column for each point, in the order of ``candidates``) to the running
    best: of each query the k best points, or with ``per_object`` the best point of each object that may be among the k best."""
    least = top.reach(who)[:, None]
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if per_object:
        value = points.column(per_object).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        best = np.maximum.reduceat(scores, starts, axis=1)
        good = best >= least
        if best.shape[1] > top.k:
            good &= best >= np.partition(np.where(good, best, -np.inf), best.shape[1] - top.k, axis=1)[:, -top.k, None]
        good &= best > -np.inf
        rows = np.flatnonzero(good.any(1))
        query, object_ = np.nonzero(good[rows])
        equal = scores[rows] == np.repeat(best[rows], np.diff(np.append(starts, len(value))), axis=1)
        first = np.minimum.reduceat(np.where(equal, np.arange(len(value), dtype=np.int32), len(value)), starts, axis=1)
        query, point = rows[query], first[query, object_]
    else:
        rows = np.flatnonzero((scores >= least).any(1))
        query, point = first_best(scores[rows], top.k)
        query = rows[query]
    if len(query):
        top.add(who[query], scores[query, point], *(points.column(c).take(pa.array(point)) for c in keys))


def found_rows(top: Best, names: pa.Array, keys: list[str]) -> Iterator[pa.RecordBatch]:
    found = top.cut()
    if found is not None:
        top.held.clear()
        columns = [names.take(found["group"]), *(found[f"k{i}"] for i in range(len(keys))), found["score"]]
        yield from pa.table(columns, ["query_id", *keys, "score"]).to_batches(1 << 16)
    release()


def hit_schema(query_vectors: DataFrame, points: DataFrame, keys: list[str]) -> str:
    kinds = dict(points.dtypes)
    return f"query_id {dict(query_vectors.dtypes)['query_id']}, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", score double"


def cosine_top(query_vectors: DataFrame, points: DataFrame, k: int, keys: list[str], per_object: str | None = None) -> DataFrame:
    """(query_id, *keys, score, rank): the k nearest points of each query by cosine, ties by the keys.

    per_object: column of which only the best point counts; empty values are skipped. Then more than k candidates per
    task are kept only where an object has several points, so the cut stays exact."""
    size = points.select(F.max(F.size("vector"))).first()[0] or 1
    out = None
    for block in query_blocks(query_vectors, 8 * size):
        rows = block.select("query_id", "vector").toArrow()  # at most QUERY_BYTES
        names = rows["query_id"].combine_chunks()
        matrix = unit(matrix_of(rows["vector"].combine_chunks()))
        held = points.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            top = running_best(k, keys, per_object)
            for batch in candidates(batches, keys, per_object):
                vectors = unit(matrix_of(batch.column("vector")))
                for low in range(0, len(names), max(1, TILE // len(vectors))):
                    part = matrix[low : low + max(1, TILE // len(vectors))]
                    offer(top, np.arange(low, low + len(part)), part @ vectors.T, batch, keys, per_object)
            yield from found_rows(top, names, keys)

        found = points.select(*keys, "vector").mapInArrow(run, hit_schema(query_vectors, points, keys))
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), *keys]
    if per_object:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("query_id", per_object).orderBy(*order))).filter("n = 1").drop("n")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def search_depth(k: int) -> int:
    """Fixed value: how many points a bounded search looks at for k results."""
    return max(5 * k, 50)


def cosine_top_within(query_vectors: DataFrame, points: DataFrame, k: int, keys: list[str], per_object: str | None = None, depth: int | None = None) -> DataFrame:
    """``cosine_top`` as a bounded search gives it: only the ``depth`` nearest points are looked at before objects fold
    and the cut to k, so fewer than k may be left."""
    hits = cosine_top(query_vectors, points, depth or search_depth(k), keys).drop("rank")
    order = [F.desc("score"), *keys]
    if per_object:
        hits = hits.filter(F.coalesce(F.col(per_object).cast("string"), F.lit("")) != "")
        hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", per_object).orderBy(*order))).filter("n = 1").drop("n")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def narrowed_hits(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hits(query_id, identity, score) of the source that a query asks for (``<source>:`` begins the identity), where it
    asks for one; the best k of what is left."""
    asked = queries.select("query_id", F.nullif(F.trim("source"), F.lit("")).alias("asked"))
    rows = hits.drop("rank").join(asked, "query_id", "left").filter(F.col("asked").isNull() | F.startswith("identity", F.concat("asked", F.lit(":")))).drop("asked")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "identity"))).filter(F.col("rank") <= k)


def managed_points(points: DataFrame, index_profile: str, embedding_profile: str, point_kind: str = "note") -> DataFrame:
    """Points that a search may see."""
    return points.filter((F.col("point_kind") == point_kind) & (F.col("index_profile") == index_profile) & (F.col("embedding_profile") == embedding_profile))


def merge_collections(hits: list[DataFrame], k: int) -> DataFrame:
    """Old collections searched one by one, merged by score; facets don't apply to them."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "identity"))).filter(F.col("rank") <= k)


EMBED_OUT = "vector array<float>, error string"


def embed_rows(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 8, id_col: str = "identity", text_col: str = "text") -> DataFrame:
    """(id, vector, error): texts in batches; a batch that fails is tried row by row and a row that fails carries its
    error; a wrong number of vectors or dimensions is a failure."""

    def checked(texts: list[str]) -> list[list[float]]:
        got = [list(map(float, v)) for v in embed(texts)]
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(got)} vectors")
        if any(len(v) != dim for v in got):
            raise ValueError(f"a vector has not {dim} dimensions")
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in batches:
            for low in range(0, len(data), batch):
                part, done = data.iloc[low : low + batch], []
                try:
                    done = [(v, None) for v in checked(part[text_col].fillna("").tolist())]
                except Exception:
                    for text in part[text_col].fillna(""):
                        try:
                            done.append((checked([text])[0], None))
                        except Exception as e:  # the row reports it
                            done.append((None, str(e)))
                yield pd.DataFrame({id_col: part[id_col].tolist(), "vector": [v for v, _ in done], "error": [e for _, e in done]})

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, {EMBED_OUT}")
