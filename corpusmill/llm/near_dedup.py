"""Near-duplicate detection with DartMinHash signatures over weighted word shingles.

A document is a weighted set: each run of five words weighs as often as it stands. Darts are thrown at the plane of
weight and rank above every element by hashing alone (a Poisson process of rate one; equal elements get equal darts in
every document); those inside a document's region [0, weight) x [0, t / total weight) hit it, about t = k ln k + 2k of
them. A dart also carries one of k coordinates; the earliest dart of each coordinate is the signature, whose agreement
estimates the weighted Jaccard similarity. The work follows the total weight plus the hits, not their product with k.

Signatures keep 16 bits of a dart and are cut into bands. Documents with the same words are one class, and the hash of
these words is the class in all that follows. In every band bucket each class is paired with the bucket's smallest (its
hub) and the pair is checked exactly. Where a bucket then still holds several
components, members outside its largest one become pivots, a few at first and then more: tasks compare a pivot's
signature with slices of the bucket and pass on only pairs that may be links between components. It ends when each
bucket is one component or all those members have been pivots, so no link between components is lost, while a large
bucket of true copies costs one pair a row. Links are exact weighted Jaccard >= threshold; a group is a connected
component; its smallest identifier names it and stays.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined cases: a text of one to four words has one
shingle (all its words); a null or empty text, or one without words, has none and is a group of its own; rows with a
null identifier are left out by ``near_dedup`` and kept by ``keep_one_each`` (they can't name a group); repeated
identifiers count as one document per distinct sequence of words, each with links of its own, and one that names a group
stays with all its texts there; a very long text is one row of work; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import connected_components, joined_components
from .narrowing import perhaps_among
from .store import materialise
from .textbytes import U64, mix, slices, text_buffers, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Signature agreement below which a pair isn't checked: 5 standard deviations below the threshold.
SLACK = 0.18
#: Members of a bucket that one task compares with as many of its pivots at most; pivots of a bucket in the first round
#: (then 4, 16, .. times as many, until every member outside the bucket's largest component has been one).
SLICE, PIVOTS = 4096, 64
#: Cells from which a brief set keeps 32 bits of each.
MANY = 4096
#: Pairs of a pivot in the first round.
BEST = 2
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], U64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, hash of all words of each row): every run of five words, in order."""
    hashes, row, first = words(*text_buffers(texts))
    size = np.diff(first)
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes)) - first[:-1][row]
        fold = mix(hashes + mix(place.astype(U64) + U64(7)))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(fold)])
        whole = mix((sums[first[1:]] - sums[first[:-1]]) + size.astype(U64))
        head = np.flatnonzero((place == 0) | (place + SHINGLE <= size[row]))
        head = head[(place[head] + SHINGLE <= size[row[head]]) | (size[row[head]] < SHINGLE)]
        total = np.zeros(len(head), U64)
        for i in range(SHINGLE):
            at = np.minimum(head + i, len(hashes) - 1)
            total += np.where(place[head] + i < size[row[head]], hashes[at] * _MULTIPLIERS[i], U64(0))
    return mix(total), row[head], whole


def unit_cells(element: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts whole weights into cells of weight one: the i-th equal element of a row is cell (element, i)."""
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    times = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    with np.errstate(over="ignore"):
        return mix(element + times.astype(U64) * U64(0xA0761D6478BD642F)), row


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from hashes."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_minhash(cell: np.ndarray, row: np.ndarray, height: np.ndarray | None, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) signatures; rows without cells stay zero.

    cell: hash of (element, whole part of the weight axis); height: how much of that cell's unit of weight the region
    covers (None: all of it). Ranks of a cell's darts are sums of exponential gaps, each from a hash of (cell, n)."""
    weight = np.bincount(row, height, n_rows) if height is not None else np.bincount(row, minlength=n_rows).astype(float)
    out = np.zeros((n_rows, k), np.uint32)
    todo, darts = np.flatnonzero(weight), k * math.log(k) + 2 * k
    while len(todo):
        limit = np.zeros(n_rows)
        limit[todo] = darts / weight[todo]
        live = np.flatnonzero(limit[row] > 0)
        rank, hits, n = np.zeros(len(live)), [], 0
        while len(live):
            with np.errstate(over="ignore"):
                code = mix(cell[live] + U64(2 * n + 1) * U64(0xE7037ED1A0B428DB))
            rank = rank - np.log(_unit(code))
            inside = rank < limit[row[live]]
            live, rank, code = live[inside], rank[inside], mix(code[inside] ^ U64(0x8EBC6AF09C88C6E3))
            hit = np.arange(len(live)) if height is None else np.flatnonzero(_unit(mix(code ^ U64(0x589965CC75374CC3))) <= height[live])
            hits.append((row[live[hit]] * k + ((code[hit] >> U64(32)) % U64(k)).astype(np.int64), rank[hit], code[hit].astype(np.uint32)))
            n += 1
        slot, rank, code = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((rank, slot))
        slot, at = np.unique(slot[order], return_index=True)
        flat, full = np.zeros(n_rows * k, np.uint32), np.bincount(slot // k, minlength=n_rows)
        flat[slot] = code[order][at]
        done = todo[full[todo] == k]
        out[done] = flat.reshape(n_rows, k)[done]
        todo, darts = todo[full[todo] < k], darts * 2
    return out


def signatures(docs: DataFrame, k: int = BANDS * ROWS) -> DataFrame:
    """doc_id, th (hash of the text), same (hash of the sequence of words), weight (shingles), signature (k unsigned
    16-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            element, row, whole = shingles(batch.column("text"))
            n = batch.num_rows
            signature = dart_minhash(*unit_cells(element, row), None, n, k).astype(np.uint16)
            data = pa.array([x.tobytes() for x in signature], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(whole.view(np.int64)), pa.array(np.bincount(row, minlength=n)), data], ["doc_id", "th", "same", "weight", "signature"])

    return docs.mapInArrow(run, "doc_id long, th long, same long, weight long, signature binary")


@F.arrow_udf(LongType())
def word_class(texts: pa.Array) -> pa.Array:
    """The hash of the sequence of words of each text, as ``same`` of its signature."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(shingles(part.column("text"))[2].view(np.int64) for part in slices([batch]))]))


def _numbers(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint16).reshape(-1, k)


def _fold(numbers: np.ndarray, seed: int) -> np.ndarray:
    total = np.full(len(numbers), seed, U64)
    with np.errstate(over="ignore"):
        for column in numbers.T:
            total = mix(total * U64(0x9E3779B97F4A7C15) + column.astype(U64))
    return total.view(np.int64)


def band_keys(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node): one key per band and class; copies of a class fold within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, at = np.unique(batch.column("same").to_numpy(), return_index=True)
            numbers = _numbers(batch, "signature", bands * rows)[at]
            for band in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(_fold(numbers[:, band * rows : (band + 1) * rows], band)), pa.array(node)], ["key", "node"])

    return signed.filter("weight > 0").select("same", "signature").mapInArrow(run, "key long, node long")


def _brief(cells: np.ndarray) -> bytes:
    """Sorted cells cut to 16 bits, or 32 where there are many."""
    return np.sort(cells.astype(np.uint16 if len(cells) < MANY else np.uint32)).tobytes()


def _briefly_alike(x: bytes, n: int, y: bytes, m: int, threshold: float) -> bool:
    a, b = (np.frombuffer(v, np.uint16 if size < MANY else np.uint32) for v, size in ((x, n), (y, m)))
    if a.dtype != b.dtype:
        a, b = np.sort(a.astype(np.uint16)), np.sort(b.astype(np.uint16))
    return _alike(a, b, threshold)


def class_table(signed: DataFrame, members: DataFrame) -> DataFrame:
    """(node, doc_id, th, weight, signature): of each class in a bucket, one of its texts."""
    wanted = materialise(members.select("node").distinct(), "bucket-nodes")
    rows = perhaps_among(signed.filter("weight > 0").withColumnRenamed("same", "node"), "node", wanted)
    classes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("weight").alias("weight"), F.first("signature").alias("signature"))
    return classes.join(wanted, "node", "left_semi").select("node", "one.*", "weight", "signature")


def pivot_pairs(members: DataFrame, pivots: DataFrame, nodes: DataFrame, cells: DataFrame, threshold: float, k: int, most: int, best: int | None = None) -> DataFrame:
    """(a, b): pairs of a bucket's members(key, node, label, size) and pivots(key, node, label, size), about ``most`` of
    these per bucket, in different components whose signatures and weights allow the threshold. With ``best``, so many
    of each pivot and slice; else all that share enough cells, cut to fewer bits (which can only add pairs, for the
    exact check to drop).

    A bucket is dealt in slices of about SLICE members, each with about SLICE pivots of its bucket at a time; a task
    compares arrays and passes on only the pairs that may be links."""
    low = max(0.0, threshold - SLACK)
    sign = nodes.select("node", "signature", "weight")
    sign = sign.withColumn("brief", F.lit(None).cast("binary")) if best else sign.join(cells.select("node", "brief"), "node")
    slices_, turns = F.ceil(F.col("size") / SLICE).cast("int"), max(1, most // SLICE)
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = members.withColumn("slice", own(slices_)).withColumn("turn", every(F.lit(turns))).join(sign, "node")
    right = pivots.drop("turn").join(sign, "node").withColumn("turn", own(F.lit(turns))).withColumn("slice", every(slices_))

    def compare(group: pa.Table, wanted: pa.Table) -> pa.Table:
        if not group.num_rows or not wanted.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = _numbers(group, "signature", k), _numbers(wanted, "p_signature", k)
        node, label, weight = (group.column(c).to_numpy() for c in ("node", "label", "weight"))
        theirs = group.column("brief").to_pylist()
        found = []
        for i, (n, g, w, c) in enumerate(zip(*(wanted.column(f"p_{c}").to_pylist() for c in ("node", "label", "weight", "brief")))):
            hit = np.flatnonzero((label != g) & (np.minimum(weight, w) >= threshold * np.maximum(weight, w)))
            same = (x[hit] == y[i]).mean(axis=1)
            hit, same = hit[same >= low], same[same >= low]
            if best:
                hit = hit[np.argsort(-same, kind="stable")[:best]]
            elif len(hit):
                hit = hit[[_briefly_alike(c, w, theirs[j], int(weight[j]), threshold) for j in hit.tolist()]]
            found.append(np.stack([np.minimum(node[hit], n), np.maximum(node[hit], n)]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    keys = ["key", "slice", "turn"]
    columns = [*keys, "node", "label", "weight", "signature", "brief"]
    right = right.select(columns).toDF(*(f"p_{c}" for c in columns))
    dealt = left.select(columns).groupBy(*keys).cogroup(right.groupBy(*(f"p_{c}" for c in keys)))
    return dealt.applyInArrow(compare, "a long, b long").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of classes whose weights and signatures allow the threshold."""
    low = max(0.0, threshold - SLACK)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array((_numbers(batch, "sa", k) == _numbers(batch, "sb", k)).mean(axis=1) >= low)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(same), batch.column("b").filter(same)], ["a", "b"])

    sign = nodes.select("node", "signature", "weight")
    near = pairs.join(sign.toDF("a", "sa", "wa"), "a").join(sign.toDF("b", "sb", "wb"), "b").filter(F.least("wa", "wb") >= threshold * F.greatest("wa", "wb"))
    return near.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted arrays of cells reach the threshold."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= threshold * (len(x) + len(y) - both)


def weighted_cells(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, cells, brief): the weighted set of each class as sorted cells, from one of its texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            element, row, _ = shingles(batch.column("text"))
            cell, row = unit_cells(element, row)
            order = np.lexsort((cell, row))
            cell, edge = cell[order], np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            parts = [cell[a:b] for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(list(map(_brief, parts)), pa.binary())], ["node", "cells", "brief"])

    wanted = nodes.select("doc_id", "th", "node")
    texts = perhaps_among(docs, "doc_id", wanted).groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return texts.join(wanted, ["doc_id", "th"]).select("node", "text").mapInArrow(build, "node long, cells binary, brief binary")


def checked(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Of a table of pairs (a, b) of classes, those whose exact weighted Jaccard similarity reaches the threshold."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="ca"):
            good = [_alike(np.frombuffer(a, U64), np.frombuffer(b, U64), threshold) for a, b in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb")))]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    asked = materialise(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "asked-nodes")
    own = cells.select("node", "cells").join(asked, "node", "left_semi")  # few pairs move few cells
    full = pairs.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").select("a", "b", "ca", "cb")
    return full.mapInArrow(exact, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """Per document: doc_id, same (its word class; null without words), group_id and same_as."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))
    k = bands * rows
    signed = materialise(signatures(docs, k), "signatures")
    keyed = band_keys(signed, bands, rows)
    hubs = materialise(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub"), "hubs")
    members = materialise(perhaps_among(keyed, "key", hubs).join(hubs, "key"), "members")
    nodes = materialise(class_table(signed, members), "nodes")
    star = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tested = materialise(likely(star, nodes, threshold, k), "pairs")
    cells = materialise(weighted_cells(nodes, docs), "cells")
    labels = connected_components(materialise(checked(tested, cells, threshold), "near-links"))
    done, most, best = members.filter("node = hub").select("key", "node").distinct(), 16 * PIVOTS, BEST
    while True:
        part = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        sizes = part.groupBy("key", "label").agg(F.count("*").alias("n"))
        open_ = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts")).filter("parts > 1")
        part = materialise(part.join(open_, "key"), "open-members")
        # a link between two components has an end outside the bucket's largest one
        outside = part.filter("label <> main").join(done, ["key", "node"], "left_anti")
        share = F.ceil(F.col("left") / most).cast("int")
        chosen = outside.join(outside.groupBy("key").agg(F.count("*").alias("left")), "key").withColumn("turn", F.pmod(F.xxhash64("key", "node"), share) == 0)
        chosen = materialise(chosen.select("key", "node", "label", "size", "turn").distinct(), "pivots")
        if chosen.isEmpty():
            break
        chosen = chosen.filter("turn")
        at = part.join(chosen.select("key").distinct(), "key", "left_semi")
        more = materialise(pivot_pairs(at, chosen, nodes, cells, threshold, k, most, best).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialise(checked(more, cells, threshold), "near-links")
        labels, tested = joined_components(labels, found), tested.union(more)
        if best:  # the first round joins most components by each pivot's best pairs; the next ones leave nothing out
            most, best = PIVOTS, None
        else:
            done, most = done.union(chosen.select("key", "node")), most * 4
    least = signed.filter("weight > 0").groupBy("same").agg(F.min("doc_id").alias("least"))
    named = materialise(least.join(labels.withColumnRenamed("node", "same"), "same", "left"), "classes")
    heads = named.filter("label is not null").groupBy("label").agg(F.min("least").alias("head"))
    named = materialise(named.join(heads, "label", "left").select("same", "least", F.coalesce("head", "least").alias("head")), "near-groups")
    rows_ = signed.select("doc_id", F.when(F.col("weight") > 0, F.col("same")).alias("same"))
    return rows_.join(named, "same", "left").select("doc_id", "same", F.coalesce("head", "doc_id").alias("group_id"), F.coalesce("least", "doc_id").alias("same_as"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, group_id (smallest identifier of its group), kept (it is that one) and same_as (smallest
    identifier with the same words)."""
    found = _grouped(docs, id_col, text_col, threshold, bands, rows)
    return found.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"), "same_as")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for documents that are near-duplicates of a kept one."""
    found = _grouped(docs, id_col, text_col, threshold, bands, rows)
    gone = materialise(found.filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone"), F.col("same").alias("__words")).distinct(), "near-dropped")
    rows_ = docs.withColumns({"__id": F.col(id_col).cast("long"), "__class": word_class(F.col(text_col).cast("string"))})
    left = rows_.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__class") == F.col("__words")), "left_anti")
    return left.drop("__id", "__class")
