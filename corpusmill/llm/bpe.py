"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix is that of a shorter prefix plus one last token, and exactly one token that ends there is
compatible with the last token before it. So for every prefix of a word only its last token is stored. Candidates are
the tokens that end at a position, from an automaton over the vocabulary (its suffix links list them); two tokens are
compatible when the merges along the border between them never join across it. All distinct words of a slice advance
together, position by position, in array operations, and words of more than ``LONG`` letters one by one, with remembered
tests of pairs; back-pointers then give the ids.

Files: BPE with an end-of-word suffix, NFC and lower case first, words by the usual contraction/letter/digit/other
pattern, white space dropped, no decoder. Strings of added tokens in a text stand for those tokens. Decoding joins the
tokens' strings with one space. Defined cases: a null or empty text has no tokens; very long texts are encoded in parts
cut at white space, with the same ids; a long word takes time in proportion to its letters; texts with code points that
Python's Unicode tables don't know, or order, compose or lower otherwise than the library's, are normalised and
cut by the library; an empty table gives an empty result; other columns are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PART, UNKNOWN, PieceCache, Pieces, classes, parts
from .textbytes import slices

#: Separates words in the automaton's input; a byte is chr(byte), at a word's end chr(256 + byte).
BREAK = chr(0x200)
NEVER = np.iinfo(np.int64).max
#: Words that advance together.
TOGETHER = 20_000
#: Letters of words that advance together, at most, and remembered pairs.
LONG, REMEMBERED = 512, 1 << 20
#: Marks of the least and of a very high combining class: a mark that has a class changes places with one of them.
LOW_MARK, HIGH_MARK = "\u0334", "\u0345"


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.names = dict((i, s) for s, i in vocab.items())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update((i, s) for s, i in self.added.items())
        n = max(self.names) + 1
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        symbols: dict[int, str] = {}
        for name, i in vocab.items():
            if name in byte_of:
                symbols[i] = chr(byte_of[name])
            elif name.endswith(suffix) and name[: -len(suffix)] in byte_of:
                symbols[i] = chr(256 + byte_of[name[: -len(suffix)]])
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[self.names[a] + self.names[b]]
            pairs.append(a * n + b)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
                symbols[whole] = symbols[a] + symbols[b]
        order = np.argsort(pairs)
        self.n, self.pairs, self.pair_rank = n, np.asarray(pairs)[order], order
        self.size = np.zeros(n, np.int64)
        self.automaton = ahocorasick.Automaton()
        ids = np.fromiter(symbols, np.int64, len(symbols))
        # a token that its own string doesn't encode to never stands in an encoding
        merged = ids[self.rank[ids] >= 0]
        alone = np.ones(n, bool)
        alone[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for i in merged[np.argsort(self.rank[merged])].tolist():
            alone[i] &= alone[self.left[i]] and alone[self.right[i]]
        for i, s in symbols.items():
            self.size[i] = len(s)
            if alone[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.remembered: dict[tuple[int, int], bool] = {}

    def joined_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens; NEVER where there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b stay apart when their joint string is encoded (before: up to that rank of merges).

        Merges happen in order of rank, on both sides of the border independently, so the pairs that ever face each
        other there follow by undoing the later of the two last merges again and again. A pair that merges before
        either of its tokens is used up (leftmost first among equals) crosses the border."""
        good = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a, b
        x_ends = np.full(len(a), NEVER) if before is None else before
        y_ends = np.full(len(a), NEVER) if before is None else before
        while len(live):
            joined = self.joined_at(x, y)
            if before is None:
                bad = (joined < x_ends) & (joined <= y_ends) & (joined < NEVER)
            else:
                bad = (joined < x_ends) & (joined < np.where(y_ends == before, y_ends, y_ends + 1))
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, x_ends, y_ends, rx, ry = (v[go] for v in (live, x, y, x_ends, y_ends, rx, ry))
            if before is not None:
                before = before[go]
            undo = rx > ry
            x, y, x_ends, y_ends = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y]), np.where(undo, rx, x_ends), np.where(undo, y_ends, ry)
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words (pieces of normalised text, none empty)."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = words if not long else [w for w in words if len(w) <= LONG]
        ids = list(chain.from_iterable(self._together(short[i : i + TOGETHER]) for i in range(0, len(short), TOGETHER)))
        for i in long:
            ids.insert(i, self._alone(words[i]))
        return ids

    def apart(self, a: int, b: int) -> bool:
        """``compatible`` of one pair of tokens, remembered."""
        known = self.remembered.get((a, b))
        if known is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            known = self.remembered[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def _alone(self, word: str) -> list[int]:
        """Ids of one long word: the last token of each prefix, one after another."""
        raw = word.encode().decode("latin-1")
        last, sizes, apart = [-1] * (len(raw) + 1), self.size.tolist(), self.apart
        for at, token in self.automaton.iter(raw[:-1] + chr(256 + ord(raw[-1]))):
            # exactly one token that ends here is compatible, in whatever order they come
            start = at + 1 - sizes[token]
            if last[at + 1] < 0 and (not start or apart(last[start], token)):
                last[at + 1] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return ids[::-1]

    def _together(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode().decode("latin-1") for w in words]
        text = BREAK.join([r[:-1] + chr(256 + ord(r[-1])) for r in raw])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(size + 1) - size - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, token = found[:, 0] + 1, found[:, 1]
        start = end - self.size[token]
        word = np.searchsorted(begin, start, "right") - 1
        prefix = end - begin[word]
        order = np.lexsort((start, prefix))
        end, token, start, word, prefix = (v[order] for v in (end, token, start, word, prefix))
        edge = np.searchsorted(prefix, np.arange(1, size.max() + 2))
        last = np.full(len(text) + 1, -1)
        for low, high in zip(edge[:-1], edge[1:]):
            # longest candidates first; one that is alone at its position needs no test
            at, t, s, w = end[low:high], token[low:high], start[low:high], word[low:high]
            left = np.arange(high - low)
            while len(left):
                first = np.unique(at[left], return_index=True)[1] if len(left) else left
                pick = left[first]
                good = s[pick] == begin[w[pick]]
                test = np.flatnonzero(~good)
                good[test] = self.compatible(last[s[pick[test]]], t[pick[test]])
                last[at[pick[good]]] = t[pick[good]]
                left = np.delete(left, first)
                left = left[last[at[left]] < 0]
        ids: list[list[int]] = [[] for _ in words]
        live, at = np.arange(len(words)), begin + size
        steps = []
        while len(live):
            t = last[at]
            steps.append((live, t))
            at = at - self.size[t]
            go = at > begin[live]
            live, at = live[go], at[go]
        for who, what in reversed(steps):
            for i, t in zip(who.tolist(), what.tolist()):
                ids[i].append(t)
        return ids

    def normalise(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


class BpeEncoder:
    """Encodes slices of texts; of each distinct word it keeps (number of ids, ids as text, tokens as text)."""

    def __init__(self, path: str):
        self.path, self.bpe, self.values, self.kinds = path, bpe(path), [], kinds_of(path)
        self.cache = PieceCache(lambda pieces: self.values.extend(self._values(pieces)), self.values.clear, most=1 << 20)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.added, key=len, reverse=True))) + ")") if self.bpe.added else None

    def _value(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([self.bpe.names[i] for i in ids]).encode()

    def _values(self, pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        return list(map(self._value, self.bpe.encode_words(pieces)))

    def _library_words(self, text: str) -> list[str]:
        """Words by the library's own Unicode tables, for texts with code points on which Python's differ."""
        normaliser, cutter, byte_of = library_cutter(self.path)
        return [bytes(map(byte_of.__getitem__, letters)).decode() for letters, _ in cutter.pre_tokenize_str(normaliser.normalize_str(text))]

    def encode(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """Of each text, the values of its words in order."""
        out, waiting, size = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            for k, part in enumerate(self.cut.split(text) if self.cut and any(a in text for a in self.bpe.added) else [text]):
                for own in [self.bpe.added[part]] if k % 2 else parts(part):
                    waiting.append((out[i], own))
                    size += 0 if k % 2 else len(own)
                    if size > 2 * PART:
                        self._put(waiting)
                        waiting, size = [], 0
        self._put(waiting)
        return out

    def _put(self, waiting: list[tuple[list, str | int]]) -> None:
        """Appends the values of each part to its list; a number is an added token."""
        pieces = Pieces(["" if isinstance(part, int) else self.bpe.normalise(part) for _, part in waiting], False, self.kinds)
        number, first, value = self.cache.look_up(pieces).tolist(), pieces.first.tolist(), self.values.__getitem__
        unknown = set(pieces.unknown)
        for k, (out, part) in enumerate(waiting):
            if isinstance(part, int):
                out.append(self._value([part]))
            elif k in unknown:
                out += self._values(self._library_words(part))
            else:
                out += map(value, number[first[k] : first[k + 1]])


@functools.cache
def library_cutter(path: str):
    """(normaliser, pre-tokeniser, byte of each of its letters) of a file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer.normalizer, tokenizer.pre_tokenizer, {letter: byte for byte, letter in enumerate(byte_letters())}


@functools.cache
def kinds_of(path: str) -> np.ndarray:
    """The class of every code point; UNKNOWN also where Python and the library order, compose or lower differently.

    Derived from both: every mark is put beside one of the lowest and one of the highest class, every canonical
    decomposition is composed again, every letter with a lower case is lowered."""
    kinds, own = classes().copy(), bpe(path).normalise
    tests: list[tuple[int, str]] = []
    for point in map(int, np.flatnonzero(kinds != UNKNOWN)):
        c = chr(point)
        if unicodedata.combining(c):
            tests += [(point, "a" + c + LOW_MARK), (point, "a" + HIGH_MARK + c), (point, LOW_MARK + c)]
        taken_apart = unicodedata.decomposition(c)
        if taken_apart and not taken_apart.startswith("<"):
            whole = "".join(chr(int(x, 16)) for x in taken_apart.split())
            tests += [(p, x) for p in (point, *map(ord, whole[1:])) for x in (c, whole)]
        if c.lower() != c:
            tests.append((point, c))
    library = library_cutter(path)[0].normalize_str("|".join(x for _, x in tests)).split("|")
    odd = {y for (point, x), got in zip(tests, library) if own(x) != got for y in (point, *map(ord, chr(point).lower()))}
    kinds[list(odd)] = UNKNOWN
    return kinds


@functools.cache
def encoder(path: str) -> BpeEncoder:
    """The process's encoder of a file, with the words it knows."""
    return BpeEncoder(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 and, on request,
    ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids, decoded, texts = [], [], [], []
            for values in encoder(tokenizer_path).encode([t or "" for t in batch.column("text").to_pylist()]):
                n.append(sum([v[0] for v in values]))
                id_text, text = b" ".join([v[1] for v in values]), b" ".join([v[2] for v in values])
                ids.append(hashlib.sha256(id_text).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                if with_output:
                    texts.append(([int(x) for x in id_text.split()], text.decode()))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_output:
                columns |= {"ids": pa.array([x for x, _ in texts], pa.list_(pa.int32())), "decoded": pa.array([x for _, x in texts], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output)
