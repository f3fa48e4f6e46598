"""Removal of repeated passages by level-wise doubling of word windows.

A word goes when some window of ``length`` consecutive words over it also starts earlier: in a document with a smaller
identifier, or before it in the same document. Windows grow in three levels, a quarter, a half and the whole of the length,
and only those repeated at one level are extended to the next:

1. **quarter**: every window of ``length`` words has an anchor, its quarter with the least rank (leftmost among equals).
   Equal windows have equal anchors at equal distances, so only anchors are counted, about one position in eight;
   those that stand at one place only end here, and with them all windows around them;
2. **half**: an anchor is extended by the quarter after it for the windows that hold both, by the quarter before it for
   the others; its rank is the pair of ranks, and pairs that occur once end here;
3. **whole**: the windows left around one anchor are a run. Runs equal as a whole fold into one row, whose first place
   stays; the runs at all other places repeat it. Where runs of different content share a pair of ranks, the first
   place of each is cut into its windows, and of equal windows the first stays.

No candidates survive beyond that, as the next level would be past the threshold. A rank is a 64-bit hash, a window is told
by the rank of its half, its distance and a pair of fingerprints modulo primes; no words are shuffled, and a text only
where single windows must be told apart or words removed. Copies fold in each task before a shuffle; joins are between
two written tables, which split where one rank has many rows.

Defined cases: a null text has no words; texts with fewer words than ``length`` stay whole; rows that repeat (same id
and text) are one document; other rows with one id are different documents, in the order of a hash of their texts; null ids
come first; an empty table gives an empty result; a very long text is worked on whole, with some tens of bytes of
memory a byte; other columns are ignored. Windows never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .narrowing import perhaps_among, split_among
from .store import discard, materialise
from .textbytes import U64, Fingerprints, mix, run_hashes, slices, text_buffers

LENGTH = 20
KEY = ["did", "th"]
PLACE = [*KEY, "anchor"]
SLICE = 1 << 19
_odd = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
#: Bytes of words: all but space, tab, line feed, vertical tab, form feed and carriage return.
INSIDE = np.ones(256, bool)
INSIDE[[32, 9, 10, 11, 12, 13]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text) of words ``[^\\x20\\x09-\\x0D]+``, a block of words at a time."""
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[[0, -1]] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = (starts[word], ends[word]) if len(data) else (at[:0], at[:0])
    hashes, begin = np.zeros(len(starts), U64), 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + SLICE, "right")))
        low = starts[begin]
        hashes[begin:end] = run_hashes(data[low : ends[end - 1]], starts[begin:end] - low, ends[begin:end] - low)
        begin = end
    return hashes, np.searchsorted(starts, offsets, "left")


def ranks(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += hashes[j : j + n] * _odd[j % 64] ** U64(1 + j // 64)
    return mix(out)


def anchored(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ranks of all quarters, anchor, first window, last window) of the runs of windows with one anchor."""
    quarter, n = length // 4, len(hashes)
    rank, empty = ranks(hashes, quarter), np.zeros(0, np.int64)
    if n < length:
        return rank, empty, empty, empty
    least, at, step, most = rank, np.arange(len(rank)), 1, length - quarter + 1
    while step < most:
        step_on = min(step, most - step)
        less = least[step_on:] < least[:-step_on]
        least, at = np.where(less, least[step_on:], least[:-step_on]), np.where(less, at[step_on:], at[:-step_on])
        step += step_on
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(window):
        return rank, empty, empty, empty
    anchor = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    return rank, anchor[begin], window[begin], window[np.append(begin[1:], len(window)) - 1]


def _quarters(docs: DataFrame, length: int) -> DataFrame:
    """(rank, n): anchors of each task's slices and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            rank, anchor, _, _ = anchored(*word_hashes(*text_buffers(batch.column("text"))), length)
            found, n = np.unique(rank[anchor], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["rank", "n"])

    return docs.select("text").mapInArrow(run, "rank long, n long")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """(did, th, anchor, low, high, rank, half, whole): runs of windows around an anchor, by the half that they hold. The
    windows of a run start from ``high`` to ``low`` words before the anchor."""
    quarter = length // 4
    most = length - 2 * quarter  # a window that starts no further before its anchor holds the half that starts there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, first = word_hashes(*text_buffers(batch.column("text")))
            rank, anchor, begin, end = anchored(hashes, first, length)
            low, high = anchor - end, anchor - begin
            after, before = low <= most, high > most
            with np.errstate(over="ignore"):
                pair = np.concatenate([mix(rank[anchor[after]] + mix(rank[anchor[after] + quarter])), mix(~rank[anchor[before]] + mix(rank[anchor[before] - quarter]))])
            low, high = np.concatenate([low[after], np.maximum(low[before], most + 1)]), np.concatenate([np.minimum(high[after], most), high[before]])
            anchor = np.concatenate([anchor[after], anchor[before]])
            whole = Fingerprints(hashes, 1).of(anchor - high, anchor - low + length)
            row = np.searchsorted(first, anchor, "right") - 1
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(owner), batch.column("th").take(owner), pa.array((anchor - first[row]).astype(np.int64)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(rank[anchor].view(np.int64)), pa.array(pair.view(np.int64)), pa.array(whole.view(np.int64))],
                ["did", "th", "anchor", "low", "high", "rank", "half", "whole"],
            )

    return docs.mapInArrow(run, "did long, th long, anchor long, low short, high short, rank long, half long, whole long")


def _windows(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Cuts runs into their windows: (did, th, anchor, half, d, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, first = word_hashes(*text_buffers(batch.column("text")))
            items = batch.column("items")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy())
            half, anchor, low, high = (items.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("half", "anchor", "low", "high"))
            count = high - low + 1
            which = np.repeat(np.arange(len(row)), count)
            d = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            start = first[row[which]] + anchor[which] - d
            print_ = Fingerprints(hashes, 1).of(start, start + length)
            owner = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(owner), batch.column("th").take(owner), pa.array(anchor[which]), pa.array(half[which]), pa.array(d.astype(np.int16)), pa.array(print_.view(np.int64))],
                [*PLACE, "half", "d", "print"],
            )

    items = materialise(runs.groupBy(*KEY).agg(F.collect_list(F.struct("half", "anchor", "low", "high")).alias("items")), "passage-runs")
    return perhaps_among(docs, "th", items).join(items, KEY).mapInArrow(run, "did long, th long, anchor long, half long, d short, print long")


def _repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a key that stand at more than one place, but for those at the first one."""
    first = F.min(F.struct(*PLACE)).alias("first")
    firsts = materialise(rows.groupBy(*key).agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"), "first-places")
    return rows.join(firsts, key).filter(F.struct(*PLACE) != F.col("first"))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(did, th, text) -> (did, th, start, end): spans of words that cover exactly the windows that also start earlier."""
    if length < 4:
        raise ValueError("windows of fewer than four words have no quarter")
    span = lambda low, high: [*KEY, (F.col("anchor") - F.col(high)).alias("start"), (F.col("anchor") - F.col(low) + length).alias("end")]
    repeated = materialise(_quarters(docs, length).groupBy("rank").agg(F.sum("n").alias("n")).filter("n > 1").select("rank"), "repeated-quarters")
    runs = materialise(perhaps_among(_runs(docs, length), "rank", repeated).join(repeated, "rank").drop("rank"), "quarter-runs")
    discard(repeated)
    key = ["half", "low", "high", "whole"]
    classes = materialise(runs.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")), "run-classes")
    halves = materialise(classes.groupBy("half").agg(F.sum("n").alias("n"), F.count("*").alias("contents")).filter("n > 1"), "repeated-halves")
    copies = runs.join(classes.filter("n > 1").select(*key, "first"), key).filter(F.struct(*PLACE) != F.col("first"))
    copies = materialise(copies.select(*span("low", "high")), "copied-spans")
    discard(runs)
    mixed = halves.filter("contents > 1").select("half")
    windows = materialise(_windows(docs, classes.join(mixed, "half").select("half", "low", "high", "first.*"), length), "passage-windows")
    discard(classes, halves)
    spans = materialise(copies.union(_repeats(windows, ["half", "d", "print"]).select(*span("d", "d"))), "passage-spans")
    discard(copies, windows)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, n_passages (maximal removed runs) and, on request, kept_text
    (the words left, joined by one space)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"))
    spans = repeated_passages(docs.select(*KEY, "text"), length)
    lists = materialise(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "passages")
    discard(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, kept = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words, gone = (text or "").encode().split(), merged(found)
                edges = [0, *(x for run in gone for x in run), len(words)]
                left = b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]] if gone else words)
                rows.append((len(words), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest()))
                kept.append(left)
            counts = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]]
            columns = [batch.column("doc_id"), counts[0], counts[1], pa.array([r[3] for r in rows]), counts[2]]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []), [c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_passages long" + ", kept_text string" * with_text
    # documents without any span stay where they are
    touched, others = split_among(docs, "th", lists)
    columns = ["doc_id", "text", "spans"]
    rows = touched.join(lists, KEY, "left").select(columns).union(others.withColumn("spans", F.lit(None).cast(lists.schema["spans"].dataType)).select(columns))
    return rows.mapInArrow(run, schema)
