"""BM25 with a bounded result: every document is scored where it lies, and a task keeps the best of each query only.

Two passes over a block of queries. The first counts the block's terms in each document (an Arrow look-up of its tokens in
the vocabulary) and writes one short row a document: lengths of its fields, term numbers and counts. Statistics of any
profile are aggregates of that table; no posting is shuffled. The second scores the rows against all queries of the block at
once and keeps a running best ``k`` per query (or per query and source), so a task gives at most queries x k rows, and only
those meet in a window.

A block of queries is so large that its terms, times the sources that have statistics of their own, stay below ``ENTRIES``:
that bounds what is broadcast and what statistics the driver sees; more queries take more passes. Facets are sets of keys
on both sides: a document passes if it has all keys that a query needs, which is asked after scoring and before any cut.
Ties are in the order of source and identity. A null text has no terms; repeated terms of a query count each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_tokens, slug_tokens
from ..llm.textbytes import release
from ..sources.storage import materialise
from .lexical import K1, SLUG_FIELDS, WEIGHTS, B, query_terms, top_k

#: Terms of a block of queries times sources with statistics of their own.
ENTRIES = 1 << 22
#: Scores of documents and queries that a task has in memory at once, and the parts that they are sums of (or those of one document).
CELLS, PARTS = 1 << 18, 1 << 20
#: Tokens that are looked up at once, or those of one document; rows of matches that are scored at once.
TOKENS, ROWS = 1 << 18, 2048
NATURAL = Callable[[Column], Column]


def facet_keys() -> Column:
    """What a document offers to facets: ``domain:``, ``kind:``, ``status:``, ``tag:`` and ``source:`` keys."""
    named = lambda name, value: F.concat(F.lit(name + ":"), value)
    every = lambda c, f: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), f)
    one = F.array(named("kind", F.col("kind")), named("status", F.col("status")), named("source", F.col("source")))
    return F.filter(F.concat(every("domain_prefixes", lambda x: named("domain", x)), every("keywords", lambda x: named("tag", F.lower(x))), one), lambda x: x.isNotNull())


def facet_needs(*facets: str) -> Column:
    """What a query asks for, of its columns ``domain``, ``kind``, ``status``, ``tag`` and ``source``: blank ones ask nothing."""
    clean = lambda c: F.trim(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("/")) if c != "source" else F.trim(F.coalesce(F.col(c), F.lit("")))
    value = lambda c: F.lower(clean(c)) if c == "tag" else clean(c)
    return F.filter(F.array(*(F.when(clean(c) != "", F.concat(F.lit(c + ":"), value(c))) for c in facets)), lambda x: x.isNotNull())


@dataclass
class Vocabulary:
    """The terms of a block of queries: per field its terms, numbered on from ``base``; per term the queries that have it."""

    names: pa.Array
    needs: list[list[str]]
    terms: list[pa.Array]
    base: np.ndarray
    first: np.ndarray
    query: np.ndarray
    count: np.ndarray

    @property
    def size(self) -> int:
        return int(self.base[-1])


def vocabulary(rows: pa.Table, names: pa.Array, needs: list[list[str]], fields: list[str]) -> Vocabulary:
    """rows(query_id, field, term, n) of a block."""
    place = pc.index_in(rows["query_id"], names).to_numpy(zero_copy_only=False)
    n = rows["n"].to_numpy()
    terms, base, number = [], [0], np.zeros(len(rows), np.int64)
    for field in fields:
        own = np.flatnonzero(pc.equal(rows["field"], field).to_numpy(zero_copy_only=False))
        known = rows["term"].take(pa.array(own)).combine_chunks().cast(pa.string()).dictionary_encode()
        known = known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known
        number[own] = known.indices.to_numpy(zero_copy_only=False) + base[-1]
        terms.append(known.dictionary)
        base.append(base[-1] + len(known.dictionary))
    order = np.argsort(number, kind="stable")
    return Vocabulary(names, needs, terms, np.array(base), np.searchsorted(number[order], np.arange(base[-1] + 1)), place[order].astype(np.int64), n[order].astype(np.float64))


@dataclass
class Matches:
    """Blocks of queries: the vocabulary of each and its table (source, identity, facets, lengths, terms, counts)."""

    blocks: list[tuple[Broadcast, DataFrame]]
    query_type: str
    weights: dict[str, float]


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def _parts(batches: Iterator[pa.RecordBatch], n_fields: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``TOKENS`` tokens, or one row where that has more."""
    for batch in batches:
        size = sum(pc.fill_null(pc.list_value_length(batch.column(f"t{f}")), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(n_fields))
        for low, high in _ranges(size, TOKENS):
            yield batch.slice(low, high - low)
    release()


def _ranges(size: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to at most ``most``, or one item, and of at most ``rows``."""
    ends, low = np.cumsum(size), 0
    while low < len(size):
        before = ends[low - 1] if low else 0
        high = max(low + 1, min(low + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield low, high
        low = high


def _found(tokens: DataFrame, held: Broadcast, n_fields: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = held.value
        for batch in _parts(batches, n_fields):
            lengths, pairs, most = [], [], max(1, known.size)
            for f in range(n_fields):
                row, values = _flat(batch.column(f"t{f}"))
                lengths.append(np.bincount(row, minlength=batch.num_rows))
                number = pc.index_in(values.cast(pa.string()), known.terms[f])
                there = pc.is_valid(number).to_numpy(zero_copy_only=False)
                pairs.append(row[there] * most + number.drop_null().to_numpy() + known.base[f])
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * most).astype(np.int32))
            size = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_fields)
            lists = [pa.ListArray.from_arrays(size, pa.array(np.stack(lengths, 1).ravel().astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array((pair % most).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "identity", "facets")), *lists], ["source", "identity", "facets", "lengths", "terms", "counts"])

    return tokens.mapInArrow(run, "source string, identity string, facets array<string>, lengths array<long>, terms array<int>, counts array<int>")


def match(queries: DataFrame, fields: DataFrame, natural: NATURAL = natural_tokens, weights: dict[str, float] = WEIGHTS) -> Matches:
    """queries(query_id, text[, needs]) counted in fields(source, identity, *weights[, facets]), once for all profiles."""
    asked = materialise(query_terms(queries, natural, weights), "query-terms")
    needs = queries.select("query_id", F.col("needs") if "needs" in queries.columns else F.array().cast("array<string>").alias("needs"))
    n_sources = fields.select("source").distinct().count()
    n_blocks = max(1, -(-asked.count() * max(1, n_sources) // ENTRIES))
    part = lambda d: d if n_blocks == 1 else d.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
    token = lambda f: (slug_tokens if f in SLUG_FIELDS else natural)(F.coalesce(F.col(f), F.lit("")))
    facets = F.col("facets") if "facets" in fields.columns else F.array().cast("array<string>")
    tokens = fields.select("source", "identity", facets.alias("facets"), *(token(f).alias(f"t{j}") for j, f in enumerate(weights)))
    blocks = []
    for i in range(n_blocks):
        who = part(needs).toArrow()
        known = vocabulary(part(asked).toArrow(), who["query_id"].combine_chunks(), who["needs"].to_pylist(), list(weights))
        held = fields.sparkSession.sparkContext.broadcast(known)
        blocks.append((held, materialise(_found(tokens, held, len(weights)), "matches")))
    return Matches(blocks, dict(queries.dtypes)["query_id"], weights)


@dataclass
class Statistics:
    """Of each corpus: its number, mean lengths per field, inverse frequencies per term."""

    number: dict[str | None, int]
    mean: np.ndarray
    idf: np.ndarray


def statistics(table: DataFrame, known: Vocabulary, corpus: Column) -> Statistics:
    n_fields = len(known.terms)
    rows = table.groupBy(corpus.alias("corpus")).agg(F.count("*").alias("n"), *(F.sum(F.col("lengths")[f]).alias(f"f{f}") for f in range(n_fields))).collect()
    number = {r.corpus: i for i, r in enumerate(rows)}
    n = np.array([r.n for r in rows], np.float64).reshape(-1, 1)
    mean = np.array([[r[f"f{f}"] for f in range(n_fields)] for r in rows], np.float64).reshape(len(rows), n_fields) / n
    df = np.zeros((len(rows), known.size))
    found = table.select(corpus.alias("corpus"), F.explode("terms").alias("term")).groupBy("corpus", "term").agg(F.count("*").alias("n")).toArrow()  # at most ENTRIES rows
    of = np.array([number[c] for c in found["corpus"].to_pylist()], np.int64)
    df[of, found["term"].to_numpy()] = found["n"].to_numpy()
    return Statistics(number, mean, np.log(1 + (n - df + 0.5) / (df + 0.5)))


class Best:
    """The best ``k`` rows of each group so far: highest score first, ties by the keys (nulls first); with ``per``, a key, only the
    best row of each of its values counts. Scores below ``floor`` and those that are no number are of no use. What is held is
    cut when it has doubled, so it stays below three times the rows that count, and a fixed number."""

    def __init__(self, k: int, room: int = 1 << 17, keys: Sequence[str] = ("source", "identity"), per: str | None = None, floor: float = 0.0):
        self.k, self.room, self.keys, self.per, self.floor = k, room, list(keys), per, floor
        self.held, self.kept, self.fresh = [], 0, 0
        self.least = np.zeros(0)

    def reach(self, group: np.ndarray) -> np.ndarray:
        """The score below which a row of its group is of no use."""
        top = int(group.max(initial=-1)) + 1
        if top > len(self.least):
            self.least = np.concatenate([self.least, np.full(2 * top - len(self.least), self.floor)])
        return self.least[group]

    def add(self, group: np.ndarray, score: np.ndarray, *keys: pa.Array) -> None:
        useful = pa.array((score >= self.reach(group)) & (score > -np.inf))
        self.held.append(pa.table([pa.array(group), pa.array(score), *keys], ["group", "score", *self.keys]).filter(useful))
        self.fresh += self.held[-1].num_rows
        if self.fresh > max(self.room, self.kept):
            self.cut()

    def cut(self) -> pa.Table | None:
        """What is held: group, score and the keys."""
        if not self.held:
            return None
        every = pa.concat_tables(self.held)
        order = [("group", "ascending"), ("score", "descending"), *((c, "ascending") for c in self.keys)]
        every = every.take(pc.sort_indices(every, sort_keys=order, null_placement="at_start"))
        group = every["group"].to_numpy()
        if self.per is not None and len(group):
            code = every[self.per].combine_chunks().dictionary_encode(null_encoding="encode")
            first = np.unique(group * (len(code.dictionary) + 1) + code.indices.to_numpy(), return_index=True)[1]
            every = every.take(pa.array(np.sort(first)))
            group = every["group"].to_numpy()
        place = np.arange(len(group)) - np.searchsorted(group, group, "left")
        full = np.flatnonzero(place == self.k - 1)
        self.least[group[full]] = every["score"].to_numpy()[full]
        self.held = [every.filter(pa.array(place < self.k)).combine_chunks()]
        self.kept, self.fresh = self.held[0].num_rows, 0
        return self.held[0]


def best(matches: Matches, k: int, profile: str = "v1", per_source: bool = False, digits: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, source, identity, score, rank): the best k of each query, or of each query and source; statistics are
    those of the source (``v1``) or of all (``v2``). Scores are rounded to ``digits``, if given, before they are ranked."""
    out = None
    for held, table in matches.blocks:
        corpus = F.col("source") if profile == "v1" else F.lit(None).cast("string")
        facts = table.sparkSession.sparkContext.broadcast(statistics(table, held.value, corpus))
        weight = list(matches.weights.values())

        def run(batches: Iterator[pa.RecordBatch], held=held, facts=facts) -> Iterator[pa.RecordBatch]:
            known, stats, top = held.value, facts.value, Best(k)
            n_queries, weights = len(known.names), np.array(weight)
            field_of = np.repeat(np.arange(len(weights)), np.diff(known.base))
            wanted = pa.array(sorted({x for need in known.needs for x in need}), pa.string())
            asks = np.zeros((len(wanted), n_queries), np.float32)
            for q, need in enumerate(known.needs):
                asks[pc.index_in(pa.array(need, pa.string()), wanted).to_numpy(zero_copy_only=False).astype(np.int64), q] = 1
            sources: dict[str | None, int] = {}
            for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, whole.num_rows, ROWS)):
                if not n_queries:
                    continue
                batch = batch.take(pc.sort_indices(batch, sort_keys=[("source", "ascending"), ("identity", "ascending")]))
                source = batch.column("source").to_pylist()
                of = np.array([stats.number[s if profile == "v1" else None] for s in source], np.int64)
                code = np.array([sources.setdefault(s, len(sources)) if per_source else 0 for s in source], np.int64)
                row, term = _flat(batch.column("terms"))
                term, n = term.to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.float64)
                field = field_of[term]
                length = batch.column("lengths").flatten().to_numpy().reshape(batch.num_rows, -1)[row, field]
                part = weights[field] * stats.idf[of[row], term] * n / (n + k1 * (1 - b + b * length / stats.mean[of[row], field]))
                size = known.first[term + 1] - known.first[term]
                lacks = None
                if len(wanted):
                    has = np.zeros((batch.num_rows, len(wanted)), np.float32)
                    r, key = _flat(batch.column("facets"))
                    at = pc.index_in(key.cast(pa.string()), wanted)
                    has[r[pc.is_valid(at).to_numpy(zero_copy_only=False)], at.drop_null().to_numpy()] = 1
                    lacks = (1 - has) @ asks > 0
                for low, high in _ranges(np.bincount(row, size, batch.num_rows).astype(np.int64), PARTS, max(1, CELLS // n_queries)):
                    here = slice(*np.searchsorted(row, [low, high]))
                    many = size[here]
                    at = np.arange(many.sum()) + np.repeat(known.first[term[here]] - (np.cumsum(many) - many), many)
                    cell = np.repeat(row[here] - low, many) * n_queries + known.query[at]
                    score = np.bincount(cell, np.repeat(part[here], many) * known.count[at], (high - low) * n_queries)
                    if lacks is not None:
                        score[lacks[low:high].ravel()] = 0
                    hit = np.flatnonzero(score > 0)
                    score = score[hit] if digits is None else np.floor(score[hit] * 10.0**digits + 0.5) / 10.0**digits
                    doc = hit // n_queries + low
                    group = code[doc] * n_queries + hit % n_queries
                    useful = score >= top.reach(group)
                    group, score, doc = group[useful], score[useful], doc[useful]
                    order = np.lexsort((doc, -score, group))
                    sorted_ = group[order]
                    order = order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left") < k]
                    top.add(group[order], score[order], batch.column("source").take(pa.array(doc[order])), batch.column("identity").take(pa.array(doc[order])))
            found = top.cut()
            if found is not None and found.num_rows:
                query = known.names.take(pa.array(found["group"].to_numpy() % n_queries))
                top.held.clear()
                yield from pa.table([query, found["source"], found["identity"], found["score"]], ["query_id", "source", "identity", "score"]).to_batches(1 << 16)
            release()

        hits = table.mapInArrow(run, f"query_id {matches.query_type}, source string, identity string, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k, ["source"] if per_source else None)
