"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its documents into shards of a few MB, turns a shard into word ranks (words of the test set in hash
order; any other word and the end of a document is 0) and sorts the suffixes of the shard. A suffix whose next words
are not all in the test vocabulary for as long as the shortest window can't hold a match and is left out of the
array. Every test suffix is then looked up by binary search, word by word, which gives its longest match and the range
of places where its window stands. A document is whole in one shard, so no row is shuffled and a passage that a third
of all documents share costs no more than any other.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 13 consecutive words of an item, or the
whole item where it has fewer (but some). Defined cases: a null or empty text has no words and is clean; items without
words match nothing; repeated item ids count once; an empty test set leaves everything clean; null item ids are
ignored in the list of items but their windows count as hits; a very long text is a shard of its own; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import file_system, materialise
from .textbytes import Words, same_runs, slices, text_buffers

WINDOW = 13
#: A test set up to this size is broadcast; a larger one is read by the tasks in blocks of about this size.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20


class TestSuffixes:
    """Word ranks of a block of test items, with a window at each place where one starts."""

    __test__ = False  # not a test case

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        data = text_buffers(texts)
        for self.seed in range(100):  # until no two different words have one hash
            found = Words(*data, self.seed)
            hashes, first = found.hashes, found.first
            self.vocabulary, index, ranks = np.unique(hashes, return_index=True, return_inverse=True)
            self.low, self.at, self.sizes = found.low, found.starts[index], (found.ends - found.starts)[index]
            if self.same(found, ranks).all():
                break
        size = np.diff(first)
        #: Each item's words, then zeros: no lookup runs into the next item.
        at = first[:-1] + window * np.arange(len(size))
        self.words = np.zeros(len(hashes) + window * (len(size) + 1), np.int64)
        place = np.arange(len(hashes)) + np.repeat(at - first[:-1], size)
        self.words[place] = ranks + 1
        self.item = np.repeat(np.arange(len(size)), size)  # of each suffix
        self.offset = np.arange(len(hashes)) - np.repeat(first[:-1], size)
        self.start = place
        self.length = np.minimum(size, window)[self.item]  # of its window
        self.whole = size[self.item] - self.offset >= self.length  # a window starts here
        self.ids, self.window = ids, window
        self.shortest = int(np.minimum(size, window)[size > 0].min()) if len(hashes) else 0

    def same(self, found: Words, ranks: np.ndarray) -> np.ndarray:
        """Whether each word is, byte by byte, the one of that rank of the vocabulary."""
        size = found.ends - found.starts
        good = size == self.sizes[ranks]
        good[good] = same_runs(found.low, found.starts[good], self.low, self.at[ranks[good]], size[good])
        return good

    def ranks(self, found: Words) -> np.ndarray:
        """Of each word, its place in the vocabulary, from 1 on; 0 for others."""
        out = np.zeros(len(found.hashes), np.int64)
        if len(self.vocabulary) and len(out):
            near = np.minimum(np.searchsorted(self.vocabulary, found.hashes), len(self.vocabulary) - 1)
            out = np.where((self.vocabulary[near] == found.hashes) & self.same(found, near), near + 1, 0)
        return out


def narrowed(array: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, depth: int, ranks: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised binary search: first place in [low, high) whose word at ``depth`` is not below (right: is above) key."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        word = ranks[array[np.minimum(middle, len(array) - 1)] + depth]
        below = open_ & ((word <= key) if right else (word < key))
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


class Shard:
    """Suffix array of some documents' words, by their first ``window`` words."""

    def __init__(self, texts: pa.Array, tests: TestSuffixes):
        found = Words(*text_buffers(texts), tests.seed)
        first = found.first
        self.n_words = np.diff(first)
        ranks = np.zeros(len(found.hashes) + len(self.n_words) + tests.window, np.int64)
        self.place = np.arange(len(found.hashes)) + found.row  # a zero stands after each document
        ranks[self.place] = tests.ranks(found)
        self.ranks, self.begin = ranks, first[:-1] + np.arange(len(self.n_words))
        stop = np.flatnonzero(ranks == 0)
        known = np.flatnonzero(ranks)
        known = known[stop[np.searchsorted(stop, known)] - known >= tests.shortest]
        bits = max(1, int(len(tests.vocabulary)).bit_length())
        step = max(1, 63 // bits)
        keys = []
        for depth in range(0, tests.window, step):
            key = np.zeros(len(known), np.int64)
            for d in range(depth, min(depth + step, tests.window)):
                key = (key << bits) | ranks[known + d]
            keys.append(key)
        self.array = known[np.lexsort((known, *keys[::-1]))]

    def search(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each test suffix: the range of the array with its window, and the words of its longest match (up to a
        window's length)."""
        n = len(tests.start)
        low, high, longest = np.zeros(n, np.int64), np.full(n, len(self.array)), np.zeros(n, np.int64)
        for depth in range(tests.window if len(self.array) else 0):
            live = np.flatnonzero((depth < tests.length) & (low < high))
            key = tests.words[tests.start[live] + depth]
            left = narrowed(self.array, low[live], high[live], key, depth, self.ranks, False)
            right = narrowed(self.array, left, high[live], key, depth, self.ranks, True)
            left, right = np.where(key > 0, left, 0), np.where(key > 0, right, 0)
            longest[live[left < right]] = depth + 1
            gone = (left >= right) & ~tests.whole[live]
            keep = live[~gone]
            low[keep], high[keep] = left[~gone], right[~gone]
            high[live[gone]] = low[live[gone]]
        return low, high, longest

    def extended(self, tests: TestSuffixes, suffix: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Words that each (suffix, place) pair, known to share a window, have in common in all."""
        got = tests.length[suffix].copy()
        live = np.arange(len(suffix))
        while len(live):
            a, b = tests.start[suffix[live]] + got[live], hit[live] + got[live]
            inside = (a < len(tests.words)) & (b < len(self.ranks))
            same = np.zeros(len(live), bool)
            same[inside] = (tests.words[a[inside]] == self.ranks[b[inside]]) & (tests.words[a[inside]] > 0)
            got[live[same]] += 1
            live = live[same]
        return got


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in the ranges."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]


class Blocks:
    """The test items for the tasks: broadcast where small, else in files that a task reads one after another."""

    def __init__(self, bench: DataFrame, id_col: str, text_col: str, window: int):
        bench = bench.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
        size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 24), F.lit(0))).first()[0]
        self.window, self.value, self.path = window, None, None
        if size <= BLOCK_BYTES:
            self.value = bench.sparkSession.sparkContext.broadcast(bench.toArrow())
        else:
            self.path = materialise(bench.repartition(size // BLOCK_BYTES + 1), "test-items").inputFiles()

    def __iter__(self) -> Iterator[TestSuffixes]:
        if self.path is None:
            tables = [self.value.value]
        else:
            import pyarrow.parquet as pq

            tables = (pq.read_table(path, filesystem=fs) for fs, path in map(file_system, self.path))
        for table in tables:
            yield TestSuffixes(table.column("item_id").to_pylist(), table.column("text").combine_chunks(), self.window)


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Judge:
    """Hit words and items of slices of documents."""

    def __init__(self, blocks: Blocks):
        self.blocks = [*blocks] if blocks.path is None else blocks

    def __call__(self, texts: pa.Array, with_items: bool = True) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """Of each text: its words, its hit words, and the ids of items with windows in it (none where not asked for)."""
        edges, counts, items = None, np.zeros(len(texts), np.int64), [set() for _ in range(len(texts))]
        for tests in self.blocks:
            shard = Shard(texts, tests)
            counts = shard.n_words
            edges = np.zeros(len(shard.ranks) + 1, np.int64) if edges is None else edges
            low, high, _ = shard.search(tests)
            suffix = np.flatnonzero(tests.whole & (low < high))
            # equal windows of several suffixes have one range of the array: each place is looked at once a window
            ranges, window = np.unique(np.stack([low[suffix], high[suffix], tests.length[suffix]], axis=1), axis=0, return_inverse=True)
            window = window.ravel()
            which, at = _expand(ranges[:, 0], ranges[:, 1])
            place = shard.array[at]
            np.add.at(edges, place, 1)
            np.add.at(edges, place + ranges[which, 2], -1)
            if not with_items:
                continue
            doc = np.searchsorted(shard.begin, place, "right") - 1
            doc, which = np.divmod(np.unique(doc * max(1, len(ranges)) + which), max(1, len(ranges)))
            window, item = np.divmod(np.unique(window * len(tests.ids) + tests.item[suffix]), max(1, len(tests.ids)))
            edge = np.searchsorted(window, np.arange(len(ranges) + 1))
            whose, at = _expand(edge[which], edge[which + 1])
            for d, i in zip(doc[whose].tolist(), item[at].tolist()):
                if tests.ids[i] is not None:
                    items[d].add(tests.ids[i])
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
        return counts, inside[shard.begin + counts] - inside[shard.begin], items


def _contaminated(words_: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return (hit > 0) & (20 * hit >= words_)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with such
    windows), items_sha256 (of their ids, sorted as strings, comma-joined) and contaminated (at least a twentieth of
    the words are hit)."""
    blocks = Blocks(bench, item_col, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(blocks)
        for batch in slices(batches, most=SHARD_BYTES):
            counts, hit, items = judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array(_contaminated(counts, hit))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated."""
    blocks = Blocks(bench, item_col, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(blocks)
        for batch in slices(batches, text=text_col, most=SHARD_BYTES):
            yield batch.filter(pa.array(~_contaminated(*judge(batch.column(text_col), with_items=False)[:2])))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Of every place in a test item where a window stands in some document: item_id, item_word, n_words of the
    longest verbatim match, and the first document and word where it stands."""
    blocks = Blocks(bench, item_col, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SHARD_BYTES):
            ids = batch.column("doc_id").to_pylist()
            for tests in blocks:
                shard = Shard(batch.column("text"), tests)
                low, high, _ = shard.search(tests)
                suffix = np.flatnonzero(tests.whole & (low < high))
                which, at = _expand(low[suffix], high[suffix])
                suffix, place = suffix[which], shard.array[at]
                length = shard.extended(tests, suffix, place)
                doc = np.searchsorted(shard.begin, place, "right") - 1
                best = np.lexsort((place, -length, suffix))
                best = best[np.unique(suffix[best], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tests.ids[i] for i in tests.item[suffix[best]]], pa.string()), pa.array(tests.offset[suffix[best]]), pa.array(length[best]), pa.array([ids[d] for d in doc[best]], pa.int64()), pa.array(place[best] - shard.begin[doc[best]])],
                    ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    return rows.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("best")).select("item_id", "item_word", (-F.col("best.n")).alias("n_words"), "best.doc_id", "best.doc_word")
