"""Dictionary segmentation of CJK runs, for search.

A run of ideographs is cut along its cheapest route: a term of the lexicon costs the logarithm of total over frequency, an
ideograph that is no term as much as a term seen once. Costs are whole numbers (``UNIT`` to a natural logarithm), so
sums are exact and a tie goes to the longer first word. Each word then also gives the terms of two ideographs in it if it
is longer than two, and those of three if it is longer than three.

A lexicon is a table of terms and frequencies. It goes to the tasks whole, so its size is checked first; a dictionary of a
language doesn't grow with the corpus. Terms that are null or empty or have no positive frequency are skipped, those that repeat add up.
Terms are compared in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CJK, CJK_RANGES, MAX_TOKEN, slug_tokens

UNIT = 1 << 20
#: Bytes of a lexicon's terms, with 16 a term.
LEXICON_BYTES = 64 << 20
#: Longest beginning of a term that is held, so that a lexicon takes memory in proportion to its size.
PREFIX = 32
#: Words that are cut at once, and cut words that a worker remembers.
AT_ONCE, REMEMBERED = 1 << 16, 1 << 15
#: Words of a text that are a row of their own.
PIECE = 64


class Lexicon:
    """Costs of terms, and the beginnings by which a walk along a run knows when to stop."""

    def __init__(self, terms: Iterable[tuple[str, int]]):
        freq: dict[str, int] = {}
        for term, n in terms:
            if term and n is not None and n > 0:
                freq[term.lower()] = freq.get(term.lower(), 0) + n
        total = max(1, sum(freq.values()))
        self.unknown = self._cost(total, 1)
        self.costs = {term: self._cost(total, n) for term, n in freq.items()}
        self.longest = max(map(len, self.costs), default=0)
        self.begins = {term[:n] for term in self.costs for n in range(1, min(len(term), PREFIX + 1))}
        self.known: dict[str, list[str]] = {}

    @staticmethod
    def _cost(total: int, n: int) -> int:
        return math.floor(UNIT * math.log(total / n) + 0.5)

    def cut(self, run: str) -> list[str]:
        """The words of the cheapest route through a run."""
        n = len(run)
        least, size = [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best, at, j = self.costs.get(run[i], self.unknown) + least[i + 1], 1, i + 1
            most = min(n, i + self.longest)
            while j < most and (j - i > PREFIX or run[i:j] in self.begins):
                j += 1
                cost = self.costs.get(run[i:j])
                if cost is not None and cost + least[j] <= best:
                    best, at = cost + least[j], j - i
            least[i], size[i] = best, at
        words, i = [], 0
        while i < n:
            words.append(run[i : i + size[i]])
            i += size[i]
        return words

    def search_tokens(self, run: str) -> list[str]:
        """Words of the run, each after the terms of two and of three ideographs inside it."""
        out = []
        for word in self.cut(run):
            for n in (2, 3):
                if len(word) > n:
                    out += [g for i in range(len(word) - n + 1) if (g := word[i : i + n]) in self.costs]
            out.append(word)
        return out

    def tokens(self, word: str) -> list[str]:
        """Search tokens of a word of one script: its own where it has no ideographs."""
        if not any(low <= ord(word[0]) <= high for low, high in CJK_RANGES):
            return [word]
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.search_tokens(word)
            if len(word) > MAX_TOKEN:
                return found
            self.known[word] = found
        return self.known[word]


def read_lexicon(table: DataFrame) -> Lexicon:
    """table(term, freq), of at most ``LEXICON_BYTES``."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    if size > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {size} bytes is beyond {LEXICON_BYTES}")
    held = table.select("term", F.col("freq").cast("long").alias("freq")).toArrow()
    return Lexicon(zip(held["term"].to_pylist(), held["freq"].to_pylist()))


def _each(words: pa.Array, lexicon: Lexicon) -> pa.ListArray:
    """The tokens of each word; every distinct one is cut once."""
    coded = words.dictionary_encode()
    found = [lexicon.tokens(w) for w in coded.dictionary.to_pylist()]
    return pa.array(found, pa.list_(pa.string())).take(coded.indices)


def cut_lists(words: pa.Array, lexicon: Lexicon) -> pa.Array:
    """Lists of words as lists of their tokens, null lists as null; ``AT_ONCE`` words at a time, or one list."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin, out = np.cumsum(size), 0, []
    while begin < len(words):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        part = words.slice(begin, end - begin)
        each = _each(part.flatten().cast(pa.string()), lexicon)
        edges = np.concatenate([[0], ends[begin:end] - before])
        at = each.offsets.to_numpy()[edges]
        there = pc.is_valid(part).to_numpy(zero_copy_only=False)
        out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(~there, False)), each.values))
        begin = end
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def words(text: Column) -> Column:
    """Runs of ideographs and runs of other letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({CJK}+|[\p{{L}}\p{{N}}&&[^{CJK[1:-1]}]]+)"), 1)


def cutter(table: DataFrame) -> Callable[[Column], Column]:
    """From words, as ``words`` gives them, to tokens of at most 40 characters: runs of ideographs are cut by the lexicon.
    Python gets them as Arrow batches."""
    held = table.sparkSession.sparkContext.broadcast(read_lexicon(table))

    @F.arrow_udf("array<string>")
    def cut(words: pa.Array) -> pa.Array:
        return cut_lists(words, held.value)

    return lambda words: F.filter(cut(words), lambda t: F.length(t) <= MAX_TOKEN)


def segmenter(table: DataFrame) -> Callable[[Column], Column]:
    """A tokenizer of natural text, in the place of ``natural_tokens``: words in lower case, at most 40 characters each,
    runs of ideographs cut by the lexicon. Python sees only the words of texts that have ideographs."""
    cut = cutter(table)

    def natural(text: Column) -> Column:
        has = text.rlike(CJK)
        return F.when(has, cut(F.when(has, words(text)))).otherwise(F.filter(slug_tokens(text), lambda t: F.length(t) <= MAX_TOKEN))

    return natural


def pieces(rows: DataFrame, column: str = "words", size: int = PIECE) -> DataFrame:
    """rows, of whose list of words each gives parts of at most ``size``: so that a batch of rows is small whatever the texts."""
    at = F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0)), F.lit(size))
    return rows.select(*(c for c in rows.columns if c != column), F.explode(F.transform(at, lambda i: F.slice(column, i + 1, size))).alias(column))
