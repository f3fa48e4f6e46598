"""Whole-text encoding with a tokenizers file: every distinct piece goes through the library once per worker process.

The pieces are those of the GPT-2 pre-tokeniser, so encoding a text is encoding its pieces one after another. A text
that holds the string of an added token, or a code point that Python's Unicode tables don't know, goes to the library
whole. A long text is cut into pieces part by part.
"""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np

from .pretokens import PART, Growing, PieceCache, Pieces, parts

#: Characters of new words that are encoded as one text.
TOGETHER = 1 << 16


@functools.cache
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = (tokenizer.pre_tokenizer and tokenizer.pre_tokenizer.__class__.__name__, tokenizer.normalizer)
    if kind != ("ByteLevel", None):
        raise ValueError(f"{path}: only byte-level files without a normaliser can be encoded piece by piece")
    return tokenizer


class Encoder:
    """Encodes slices of texts; keeps the ids of each distinct piece in one flat array."""

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        decoder = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in decoder.values()]
        #: Bytes of each token: the letters of its name, as each stands for a byte.
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for name, i in vocab.items():
            self.bytes[i] = len(name)
        self.cache = PieceCache(self._learn, self._forget, most=3 << 20)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.begin, self.size = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Plain words with their space keep apart when joined, so they are encoded many at a time and cut apart by the
        bytes of their tokens; other pieces are encoded one by one."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        plain = np.array([p[0] == " " and p[1:].isascii() and p[1:].isalpha() for p in pieces], bool)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        turn = np.cumsum(length * plain) // TOGETHER
        for which in np.split(np.flatnonzero(plain), np.flatnonzero(np.diff(turn[plain])) + 1):
            if len(which):
                ids = np.array(self._one("".join([pieces[i] for i in which.tolist()])), np.int32)
                edge = np.append(0, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(length[which])) + 1)
                begin[which], size[which] = self.ids.size + edge[:-1], np.diff(edge)
                self.ids.extend(ids)
        other = np.flatnonzero(~plain)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in other.tolist()], add_special_tokens=False)]
        size[other] = list(map(len, found))
        begin[other] = self.ids.size + np.cumsum(size[other]) - size[other]
        self.ids.extend(np.fromiter(chain.from_iterable(found), np.int32))
        self.begin.extend(begin)
        self.size.extend(size)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str], whole: frozenset[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's begin, and the end). whole: texts that the library
        takes as they are."""
        if whole is None:
            whole = frozenset(i for i, t in enumerate(texts) if any(a in t for a in self.added))
        cut = [(i, part) for i, text in enumerate(texts) if i not in whole for part in parts(text)]
        ids, owner, count, begin = [], [], [], 0
        while begin < len(cut):
            end, room = begin, 2 * PART
            while end < len(cut) and (end == begin or room >= len(cut[end][1])):
                room -= len(cut[end][1])
                end += 1
            pieces = Pieces([part for _, part in cut[begin:end]], leading_space=True)
            if pieces.unknown:
                return self.encode(texts, whole | {cut[begin + k][0] for k in pieces.unknown})
            number = self.cache.look_up(pieces)
            size = self.size.array[number]
            ends = np.cumsum(size)
            ids.append(self.ids.array[np.arange(size.sum()) + np.repeat(self.begin.array[number] - ends + size, size)])
            owner += [i for i, _ in cut[begin:end]]
            count.append(np.diff(np.append(0, ends)[pieces.first]))
            begin = end
        for i in whole:
            ids.append(np.array(self._one(texts[i]), np.int32))
            owner.append(i)
            count.append(np.array([len(ids[-1])]))
        counts = np.concatenate([np.zeros(0, np.int64), *count])
        edge = np.append(0, np.cumsum(np.bincount(np.array(owner, np.int64), counts, len(texts)).astype(np.int64)))
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        if whole:  # they stand at the end: back to their places
            order = np.argsort(np.array(owner, np.int64), kind="stable")
            ends = np.cumsum(counts)
            size = counts[order]
            flat = flat[np.arange(len(flat)) + np.repeat((ends - counts)[order] - np.cumsum(size) + size, size)]
        return flat, edge


@functools.cache
def encoder(path: str) -> Encoder:
    """The process's encoder of a file, with the pieces it knows."""
    return Encoder(path)
