"""Removal of long repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes when some string of ``length`` bytes over it also starts anywhere else in the corpus. Sorting the suffixes
at every byte would shuffle each byte's position many times over, so only synchronised positions are sorted: every
window of ``length`` bytes has an anchor, the start of its least fingerprint of ``length - 255`` bytes (leftmost among
equals). Equal windows have equal anchors at equal distances, so windows need comparing only below one anchor rank and
distance. Ranks then grow in length, each the pair of the rank so far and what follows, and positions whose rank is
unique are dropped before the next, longer one, until a rank is past the threshold:

1. the anchor's own ``length - 255`` bytes (less where the length is): unique anchors go;
2. the whole run of windows that share the anchor (``length`` bytes or more): all copies of a repeated run are
   repeated; one stands for them from here on;
3. blocks of 16 windows: first the bytes common to the block (``length - 15``), unique ones go; then the bytes of the
   whole block (``length + 15``), repeated ones are past the threshold;
4. single windows of ``length`` bytes.

Only ranks and positions are sorted; a text is read where its anchors are taken, where undecided runs are cut into
blocks, and where the spans are removed. Large groups fold into one row per distinct content before they meet, and
rows with one rank never meet in one task (aggregates combine, joins are plain shuffles that split where skewed).

A rank is a pair of 62-bit fingerprints modulo primes. Defined cases: a null text is empty; texts shorter than ``length`` stay
whole; rows that repeat (same id and text) are copies of each other; rows with null ids are handled like any other; an
empty table gives an empty result; a very long text is worked on whole, with some hundred bytes of memory a byte; other
columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .narrowing import perhaps_among, split_among
from .store import materialise
from .textbytes import Fingerprints, Words, slices, text_buffers

LENGTH = 400
#: Words of a repeated passage.
PASSAGE = 51
#: Windows of a block, at most.
BLOCK = 16
KEY = ["did", "th"]
Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text), as ``text_buffers`` gives bytes."""
    found = Words(*text_buffers(texts))
    return found.hashes, found.first


def reach(length: int) -> int:
    """Windows that may share an anchor: a power of two of some 2/3 of the length, 256 at most."""
    return min(256, 1 << max(1, length * 2 // 3).bit_length() - 1)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(rank of the anchor, anchor, first window, last window) of the runs of windows with one anchor."""
    n, most = len(data), reach(length)
    gram = length - most + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), empty, empty, empty
    start = np.arange(n - gram + 1, dtype=np.int32 if n < 2**31 else np.int64)
    rank = Fingerprints(data, 0).of(start, start + gram)
    least, at, step = rank, start, 1
    while step < most:
        less = least[step:] < least[:-step]
        least, at = np.where(less, least[step:], least[:-step]), np.where(less, at[step:], at[:-step])
        step *= 2
    size = np.diff(offsets)
    long_ = size >= length
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[:-1][long_], 1)
    np.add.at(edge, offsets[1:][long_] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    if not len(window):
        return np.zeros(0, np.uint64), empty, empty, empty
    anchor = at[window].astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    return rank[anchor[begin]], anchor[begin], window[begin], window[end]


def _runs(docs: DataFrame, length: int, units: Units) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            data, offsets = units(batch.column("text"))
            rank, anchor, first, last = window_runs(data, offsets, length)
            row = np.searchsorted(offsets, first, "right") - 1
            whole = Fingerprints(data, 1).of(first, last + length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(pa.array(row)), batch.column("th").take(pa.array(row)), pa.array((anchor - offsets[row]).astype(np.int64)), pa.array((anchor - last).astype(np.int16)), pa.array((anchor - first).astype(np.int16)), pa.array(rank.view(np.int64)), pa.array(whole.view(np.int64))],
                ["did", "th", "anchor", "low", "high", "rank", "whole"],
            )

    return docs.mapInArrow(run, "did long, th long, anchor long, low short, high short, rank long, whole long")


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of these counts, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _blocks(docs: DataFrame, runs: DataFrame, length: int, units: Units) -> DataFrame:
    """Cuts runs into blocks of windows: rank of the common units, of all units (whole blocks only), of each window."""
    wide = min(BLOCK, reach(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            data, offsets = units(batch.column("text"))
            print_, items = Fingerprints(data, 1), batch.column("items")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy())
            rank, place, first, last, alone = (items.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "anchor", "low", "high", "alone"))
            count = last // wide - first // wide + 1
            which = np.repeat(np.arange(len(row)), count)
            block = _within(count) + first[which] // wide
            low, high = np.maximum(block * wide, first[which]), np.minimum(block * wide + wide - 1, last[which])
            anchor = (place + offsets[row])[which]
            start = anchor - block * wide
            each = high - low + 1
            of = np.repeat(np.arange(len(block)), each)
            window = anchor[of] - low[of] - _within(each)
            prints = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)).astype(np.int32)), pa.array(print_.of(window, window + length).view(np.int64)))
            common, all_ = print_.of(start, start - wide + 1 + length), print_.of(anchor - high, anchor - low + length)
            owner = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(owner), batch.column("th").take(owner), pa.array(place[which]), pa.array(alone[which] > 0), pa.array(rank[which]), pa.array(block), pa.array(low), pa.array(high), pa.array(common.view(np.int64)), pa.array(all_.view(np.int64), mask=high - low != wide - 1), prints],
                ["did", "th", "anchor", "alone", "rank", "block", "low", "high", "common", "all", "each"],
            )

    items = materialise(runs.groupBy(*KEY).agg(F.collect_list(F.struct("rank", "anchor", "low", "high", "alone")).alias("items")), "run-lists")
    return perhaps_among(docs, "th", items).join(items, KEY).mapInArrow(run, "did long, th long, anchor long, alone boolean, rank long, block long, low long, high long, common long, all long, each array<long>")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that rows of at least two different places have."""
    place = F.struct(*KEY, "anchor")
    return rows.groupBy(*keys).agg(F.min(place).alias("p"), F.max(place).alias("q")).filter(F.col("p") != F.col("q")).select(*keys)


def repeated_spans(docs: DataFrame, length: int = LENGTH, units: Units = text_buffers) -> DataFrame:
    """docs(did, th, text) -> (did, th, start, end): spans that cover exactly the units (bytes, or words) of strings of
    ``length`` units that also start anywhere else."""
    spans = []
    runs = materialise(_runs(docs, length, units), "runs")
    # written first: a join with its own aggregate would share its shuffle and couldn't split a rank that many rows have
    anchors = materialise(runs.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank"), "anchor-ranks")
    runs = materialise(perhaps_among(runs, "rank", anchors).join(anchors, "rank"), "repeated-anchors")
    run_key = ["rank", "low", "high", "whole"]
    classes = materialise(runs.groupBy(*run_key).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "anchor")).alias("rep")), "run-classes")
    spans.append(runs.join(classes.filter("n > 1").select(*run_key), run_key).select(*KEY, (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("end")))
    # undecided: anchors with several contents of which one stands alone
    mixed = materialise(classes.groupBy("rank").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("rank"), "mixed-anchors")
    undecided = classes.join(mixed, "rank").select("rank", "low", "high", "rep.*", (F.col("n") == 1).alias("alone"))
    blocks = materialise(_blocks(docs, undecided, length, units), "blocks")
    common_key = ["rank", "block", "common"]
    blocks = materialise(blocks.join(materialise(_repeated(blocks, common_key), "common-ranks"), common_key), "open-blocks")
    full_key = [*common_key, "all"]
    past = materialise(_repeated(blocks.filter(F.col("all").isNotNull()), full_key).withColumn("past", F.lit(True)), "past-blocks")
    marked = blocks.join(past, full_key, "left")
    done = marked.filter("past")
    spans.append(done.filter("alone").select(*KEY, (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("end")))
    fields = [*KEY, "anchor", "low", "each"]
    stands = done.groupBy(*full_key).agg(F.min(F.struct(*fields)).alias("rep")).select("rank", "block", "rep.*", F.lit(False).alias("alone"))
    rest = marked.filter(F.col("past").isNull()).select("rank", "block", *fields, "alone")
    windows = rest.union(stands.select(rest.columns)).select("rank", *KEY, "anchor", "alone", "low", F.posexplode("each").alias("i", "print"))
    windows = materialise(windows.select("rank", (F.col("low") + F.col("i")).alias("d"), "print", *KEY, "anchor", "alone"), "windows")
    window_key = ["rank", "d", "print"]
    spans.append(windows.filter("alone").join(materialise(_repeated(windows, window_key), "window-ranks"), window_key).select(*KEY, (F.col("anchor") - F.col("d")).alias("start"), (F.col("anchor") - F.col("d") + length).alias("end")))
    return spans[0].union(spans[1]).union(spans[2])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def covered(spans: pa.ListArray) -> np.ndarray:
    """Of each row, how many units its spans cover."""
    start, end = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    order = np.lexsort((start, row))
    start, end, row = start[order], end[order], row[order]
    apart = row * (int(end.max(initial=0)) + 1)  # no span of a row reaches into the next row's
    upto = np.maximum.accumulate(end + apart) if len(end) else end
    new = np.maximum(0, end + apart - np.maximum(start + apart, np.append(-1, upto[:-1])[: len(end)]))
    return np.bincount(row, new, len(spans)).astype(np.int64)


def _lists(spans: DataFrame, label: str) -> DataFrame:
    return materialise(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")), label)


def passage_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE) -> DataFrame:
    """(did, th, n): of each document with any, the words inside runs of ``words`` words that also stand anywhere else, in
    any case and between any other characters. Ranks are doubled over words as they are over bytes."""
    spans = _lists(repeated_spans(_keyed(docs, id_col, text_col).select(*KEY, "text"), words, text_words), "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(covered(batch.column("spans")))], [*KEY, "n"])

    return materialise(spans.select(*KEY, "spans").mapInArrow(run, "did long, th long, n long"), "passage-words")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, on request,
    kept_bytes (what is left, concatenated)."""
    return _removed(docs, id_col, text_col, length, with_text).drop(*KEY)


def remove_repeats_and_count_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = PASSAGE) -> DataFrame:
    """``remove_repeats`` with n_passage_words: words inside passages of ``words`` words or more that also stand anywhere
    else, whether or not they reach ``length`` bytes."""
    found = passage_words(docs, id_col, text_col, words)
    return _removed(docs, id_col, text_col, length).join(found, KEY, "left").withColumn("n_passage_words", F.coalesce("n", F.lit(0).cast("long"))).drop(*KEY, "n")


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, with_text: bool = False) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    spans = _lists(repeated_spans(keyed.select(*KEY, "text"), length), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, kept = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                body, runs = (text or "").encode(), _merged(found)
                edges = [0, *(x for run in runs for x in run), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(body), len(body) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                kept.append(left)
            columns = dict(zip(("n_bytes", "n_removed", "n_spans"), (pa.array(c, pa.int64()) for c in list(zip(*rows))[:3])))
            columns = {**{c: batch.column(c) for c in ("doc_id", *KEY)}, **columns, "kept_sha256": pa.array([r[3] for r in rows], pa.string())}
            if with_text:
                columns["kept_bytes"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    # documents without any span stay where they are
    touched, others = split_among(keyed, "th", spans)
    columns = ["doc_id", *KEY, "text", "spans"]
    rows = touched.join(spans, KEY, "left").select(columns).union(others.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(columns))
    return rows.mapInArrow(run, "doc_id long, did long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)
