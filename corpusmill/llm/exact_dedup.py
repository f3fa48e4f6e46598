"""Exact de-duplication with Patricia tries that own a slice of the (length, content hash) space.

Texts are equal when identical after lower-casing A-Z only; a null text is an empty one. Of equal texts the row with
the largest identifier stays. Each task first folds its own copies (so a text that fills a third of the table crosses
the shuffle once per task, not once per row), rows then go to the owner of their length and hash, sorted by them, and
the owner inserts whole byte strings into a compressed radix trie. A trie holds one subtree (one length, one hash
prefix) at a time: it is emitted and dropped when the sort order leaves it, so memory is bounded by a subtree.

Defined cases: null identifiers rank below all others (``kept`` compares null-safely, so a group with null identifiers
only keeps those rows); rows repeated with the same identifier and text are all ``kept`` (``keep_distinct`` leaves one);
a very long text is inserted whole, as one string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .narrowing import split_among
from .store import materialise
from .textbytes import slices

#: Bytes of distinct texts that a task folds before it passes them on.
FOLD_BYTES = 32 << 20


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal keeps the identifier that stays and the number of rows."""

    def __init__(self):
        self.root: list = [b"", {}, None]

    def add(self, text: bytes, keep_id: int | None, rows: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                old = node[2]
                if old is None:
                    node[2] = [keep_id, rows]
                else:
                    old[0] = larger(old[0], keep_id)
                    old[1] += rows
                return
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, [keep_id, rows]]
                return
            label = child[0]
            if not text.startswith(label, at):
                cut = shared_prefix(label, text[at : at + len(label)])
                lower = [label[cut:], child[1], child[2]]
                child[:] = [label[:cut], {label[cut]: lower}, None]
                label = child[0]
            node, at = child, at + len(label)

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            path = above + node[0]
            if node[2] is not None:
                yield path, *node[2]
            stack += [(child, path) for child in node[1].values()]


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        yield doc_id, (text or b"").lower()  # bytes.lower() changes A-Z only


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sha = [hashlib.sha256(text).hexdigest() for _, text in _normalised(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha, pa.string())], ["doc_id", "text_sha256"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of the task (per FOLD_BYTES of them)."""

    def out() -> pa.RecordBatch:
        rows = [(len(t), int.from_bytes(hashlib.sha256(t).digest()[:8], "big", signed=True), t, k, n) for t, (k, n) in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["size", "hash", "body", "keep_id", "rows"])

    seen: dict[bytes, list] = {}
    held = 0
    for batch in slices(batches):
        for doc_id, text in _normalised(batch):
            if (old := seen.get(text)) is None:
                seen[text] = [doc_id, 1]
                held += len(text) + 100
            else:
                old[0] = larger(old[0], doc_id)
                old[1] += 1
        if held > FOLD_BYTES:
            yield out()
            seen, held = {}, 0
    if seen:
        yield out()


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (size, hash): one trie per size and 16 bits of hash, emitted when it is complete."""

    def out(trie: PatriciaTrie) -> pa.RecordBatch:
        rows = [(hashlib.sha256(t).hexdigest(), k, n) for t, k, n in trie.terminals()]
        if len({r[0] for r in rows}) != len(rows):
            raise ValueError("two different texts have one SHA-256")
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["text_sha256", "keep_id", "group_size"])

    trie, subtree = None, None
    for batch in batches:
        for size, code, text, keep_id, rows in zip(*(batch.column(c).to_pylist() for c in ("size", "hash", "body", "keep_id", "rows"))):
            if (size, code >> 48) != subtree:
                if trie is not None:
                    yield out(trie)
                trie, subtree = PatriciaTrie(), (size, code >> 48)
            trie.add(text, keep_id, rows)
    if trie is not None:
        yield out(trie)


def text_owners(docs: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row per distinct normalised text of ``docs(doc_id, text)``."""
    folded = docs.select("doc_id", "text").mapInArrow(_folded, "size long, hash long, body binary, keep_id long, rows long")
    return folded.repartition(F.col("size"), F.shiftright("hash", 48)).sortWithinPartitions("size", "hash").mapInArrow(_owned, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    owners = materialise(text_owners(docs), "exact-owners")
    digests = docs.mapInArrow(_digests, "doc_id long, text_sha256 string")
    return digests.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one per distinct normalised text."""
    sha, keep = "__text_sha256", "__keep_id"
    owners = materialise(text_owners(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))), "exact-owners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text_col):
            digests = [hashlib.sha256((t or b"").lower()).hexdigest() for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, sha])

    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(sha, StringType())]))
    groups = owners.filter("group_size > 1").select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    # only texts that may have copies are shuffled; each of the others stays where it is
    copies, single = split_among(rows, sha, groups)
    joined = copies.join(groups.withColumn("__copied", F.lit(True)), sha, "left")
    kept = joined.filter(F.col("__copied").isNull() | F.col(id_col).cast("long").eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return single.select(docs.columns).union(kept.select(docs.columns))
