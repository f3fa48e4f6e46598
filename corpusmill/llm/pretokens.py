"""Vectorised pre-tokenisation: the pieces in which byte-pair encoders cut a text before they merge.

A slice of texts becomes one array of code points; token borders follow from character classes by array operations.
Distinct pieces are encoded once per slice and remembered between slices, so an encoder's work follows the number of
distinct words, not of words.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from .textbytes import U64, run_hashes, same_runs

LETTER, NUMBER, SPACE, OTHER, END, UNKNOWN = 0, 1, 2, 3, 4, 5
#: The code points of the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe in a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of a text that are cut into pieces at once.
PART = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point; UNKNOWN where this Python's Unicode tables have none (a library's may)."""
    first = {"L": LETTER, "N": NUMBER}
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    out = np.array([UNKNOWN if k == "Cn" else first.get(k[0], OTHER) for k in kinds], np.uint8)
    out[list(WHITE_SPACE)] = SPACE
    return out


def parts(text: str, most: int = PART) -> list[str]:
    """The text in parts of about ``most`` characters, each but the first from a white space after another character:
    pieces never span that border, and what stands on one side doesn't change pieces on the other."""
    out, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at < len(text) and not (ord(text[at]) in _WHITE and ord(text[at - 1]) not in _WHITE):
            at += 1
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


_WHITE = frozenset(WHITE_SPACE)


class Pieces:
    """Tokens of some texts: ``starts``/``ends`` in ``points``, ``first`` token of each text, a hash of each, and
    ``unknown``, the texts with code points that have no class here (their tokens don't count)."""

    def __init__(self, texts: list[str], leading_space: bool, kinds: np.ndarray | None = None):
        """leading_space: whitespace is kept and one space joins the piece after it; else whitespace is dropped and
        each digit stands alone. kinds: the class of every code point, if not ``classes``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        #: A zero after each text keeps texts apart.
        self.joined = "\0".join(texts) + "\0"
        self.points = points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        kind = (classes() if kinds is None else kinds)[points]
        self.unknown = np.unique(np.searchsorted(begin, np.flatnonzero(kind == UNKNOWN), "right") - 1).tolist()
        kind[begin + sizes] = END
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        if not leading_space:
            start |= kind == NUMBER
        apostrophe = np.flatnonzero((points == 39) & start & (kind == OTHER))
        apostrophe = apostrophe[kind[np.minimum(apostrophe + 1, n - 1)] == LETTER]
        if leading_space:
            apostrophe = apostrophe[(apostrophe == 0) | (points[apostrophe - 1] != 32) | (kind[apostrophe - 1] == END)]
        for at in apostrophe.tolist():
            after = self.joined[at + 1 : at + 3]
            for tail in CONTRACTIONS:
                if after.startswith(tail):
                    start[at + 1] = False
                    if at + 1 + len(tail) < n:
                        start[at + 1 + len(tail)] = True
                    break
        if leading_space:
            # a run of spaces before more text leaves its last character: a plain space to the next piece, another alone
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
            start[last] = True
            plain = last[points[last] == 32]
            start[plain + 1] = False
        start[kind == END] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        wanted = kind[starts] != END
        if not leading_space:
            wanted &= kind[starts] != SPACE
        self.starts, self.ends = starts[wanted], ends[wanted]
        self.first = np.searchsorted(self.starts, np.append(begin, n))
        self.hashes = run_hashes(points, self.starts, self.ends)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(size, self.size // 2), self.room.dtype)])
        self.room[self.size : size] = values
        self.size = size

    @property
    def array(self) -> np.ndarray:
        return self.room[: self.size]


class PieceCache:
    """Gives every distinct piece a number, once.

    Pieces are looked up by hash and then compared with the piece of that number, character by character; different
    pieces with one hash get numbers of their own. Above so many characters it starts anew."""

    def __init__(self, learn, forget, most: int = 8 << 20):
        """learn(list of new pieces, in order of their numbers); forget() when numbers start at 0 again."""
        self.learn, self.forget, self.most = learn, forget, most
        self._clear()

    def _clear(self) -> None:
        self.known, self.numbers = np.zeros(0, U64), np.zeros(0, np.int64)
        self.points, self.begin, self.size = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.others: dict[str, int] = {}

    def _add(self, pieces: Pieces, which: np.ndarray) -> np.ndarray:
        """Numbers for these pieces, which are new and distinct."""
        starts, size, old = pieces.starts[which], pieces.ends[which] - pieces.starts[which], self.points.size
        ends = np.cumsum(size)
        self.begin.extend(old + ends - size)
        self.size.extend(size)
        self.points.extend(pieces.points[np.arange(ends[-1]) + np.repeat(starts - ends + size, size)])
        text = pieces.joined
        self.learn([text[a:b] for a, b in zip(starts.tolist(), (starts + size).tolist())])
        return np.arange(self.size.size - len(which), self.size.size)

    def look_up(self, pieces: Pieces) -> np.ndarray:
        """The number of each piece."""
        if self.points.size > self.most:
            self._clear()
            self.forget()
        if not len(pieces.hashes):
            return np.zeros(0, np.int64)
        distinct, index, back = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        number = np.full(len(distinct), -1, np.int64)
        at = np.searchsorted(self.known, distinct)
        if len(self.known):
            near = np.minimum(at, len(self.known) - 1)
            same = self.known[near] == distinct
            number[same] = self.numbers[near[same]]
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._add(pieces, index[new])
            self.known, self.numbers = np.insert(self.known, at[new], distinct[new]), np.insert(self.numbers, at[new], number[new])
        number = number[back]
        size = pieces.ends - pieces.starts
        good = size == self.size.array[number]
        good[good] = same_runs(pieces.points, pieces.starts[good], self.points.array, self.begin.array[number[good]], size[good])
        for i in np.flatnonzero(~good).tolist():
            text = pieces.joined[pieces.starts[i] : pieces.ends[i]]
            if text not in self.others:
                self.others[text] = int(self._add(pieces, np.array([i]))[0])
            number[i] = self.others[text]
        return number
