"""Vectorised helpers over Arrow text columns: byte buffers, rolling fingerprints, words.

All run inside Spark tasks on slices of bounded size. A null text is an empty text everywhere.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Two primes below 2**31 and, for each of two families of fingerprints, a base modulo each; the seed of byte tables.
PRIMES = (2147483647, 2147483629)
BASES = ((1103515245, 1664525013), (1812433253, 1566083941))
SEED = 20240607


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``most`` bytes of text, or one row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    release()


def release() -> None:
    """Gives back to the system what a task has freed: its worker lives on, for tasks of other stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@functools.cache
def _table(which: int, k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED + 2 * which + k)).integers(1, PRIMES[k], 256, dtype=U64)


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int, prime: int) -> np.ndarray:
    """The first n powers of a base modulo a prime, in 32 bits each."""
    got = _powers.get((base, prime), np.ones(1, np.uint32))
    while len(got) < n:
        got = np.concatenate([got, (got * U64(pow(base, len(got), prime)) % U64(prime)).astype(np.uint32)])
    if len(got) <= 1 << 20:
        _powers[base, prime] = got
    return got[:n]


class Fingerprints:
    """Polynomial fingerprints of every substring of an array of bytes, or of hashes, in constant time each: a pair modulo
    two primes, as polynomials modulo a power of two can't tell some regular strings apart."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.parts, n = [], len(data)
        for k, (prime, base) in enumerate(zip(PRIMES, BASES[which])):
            sums = np.zeros(n + 1, U64)  # of numbers below 2**31: no overflow below 2**33 bytes
            values = _table(which, k)[data] if data.dtype == np.uint8 else (data >> U64(32 * k)) % U64(prime)
            np.cumsum(values * powers(n, base, prime) % U64(prime), out=sums[1:])
            self.parts.append((sums, powers(n + 1, pow(base, -1, prime), prime), U64(prime)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first, second = ((sums[ends] - sums[starts]) % prime * inverse[starts] % prime for sums, inverse, prime in self.parts)
        return mix(first << U64(32) | second)


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of symbols (below 2**21); runs don't overlap and stand in order.

    Every (place in the run, symbol) has a pseudo-random number and a run has their sum, so no structure within a run
    makes two of them collide, as it can in polynomials modulo a power of two."""
    if not len(starts):
        return np.zeros(0, U64)
    place = np.arange(len(symbols) + 1)
    size = ends - starts
    edge = np.append(starts, len(symbols) + 1)
    edge[0] = 0
    place -= np.repeat(starts, np.diff(edge))
    with np.errstate(over="ignore"):
        code = place.astype(U64) << U64(21)
        code[:-1] |= symbols
        code = mix(code + U64(seed) * U64(0xA0761D6478BD642F) + U64(0xE7037ED1A0B428DB))
        sums = np.add.reduceat(code, np.stack([starts, ends], axis=1).ravel())[::2]
        return mix(sums + size.astype(U64))


def same_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_starts[i]:a_starts[i] + size[i]] equals that many elements of b from b_starts[i]."""
    good = np.ones(len(size), bool)
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return good
    at = np.arange(ends[-1])
    shift = ends - size
    unlike = np.flatnonzero(a[at + np.repeat(a_starts - shift, size)] != b[at + np.repeat(b_starts - shift, size)])
    good[np.searchsorted(ends, unlike, "right")] = False
    return good


_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words after lower-casing: digits, a-z, and all bytes of characters beyond ASCII.
WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


class Words:
    """Maximal runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts with A-Z in lower case.

    ``low[starts[i]:ends[i]]`` is word i, ``row[i]`` its text, ``first[r]`` the first word of text r and ``hashes[i]`` a sum
    of one random number per (place, byte). Equal words have equal hashes; who must not take two different words for
    one compares bytes too (``same_runs``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0):
        n = len(data)
        self.low = low = LOWER[data]
        inside = WORD[low]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin = offsets[:-1][offsets[:-1] < n]
        first[begin] = inside[begin]
        end = offsets[1:][offsets[1:] > 0] - 1
        last[end] = inside[end]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = run_hashes(low, self.starts, self.ends, seed)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets, "left")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first index of each row's words) of the words of texts."""
    found = Words(data, offsets)
    return found.hashes, found.row, found.first
