"""Words of whole texts as numpy arrays: byte scans over Arrow's string buffers, no Python string per word.

Both word patterns used here end words at ASCII bytes only, so they can be read off UTF-8 bytes.
Hashes are 64-bit polynomials modulo 2**64, finished with an avalanche step; sequences of words
get two of them with different multipliers (128 bits) where equality has to be certain.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
P_BYTE, P_ONE, P_TWO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What tasks keep for the next one of the same Python worker, until a task that keeps something else starts there.

    Use it in functions of a module: one made inside another is sent to workers with copies of the globals that it names.
    """
    return _caches.setdefault(name, {})


def tidied(scan: Callable, keeps: str | None = None) -> Callable:
    """A mapInArrow function that hands freed memory back when its task starts, for the stages before, and when it ends: Python workers live on.

    Of the caches only ``keeps`` stays.
    """

    @functools.wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from scan(batches)
        release(keeps)

    return run


def release(keeps: str | None = None) -> None:
    """Hand freed memory back to the system, with all caches but ``keeps`` and the tables of powers, which are soon made again."""
    for name, held in _caches.items():
        if name != keeps:
            held.clear()
    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: [^\x20\x09-\x0D]+
PLAIN = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and its inverse modulo 2**64 for i < n at least; kept, and grown by doubling."""
    have = _tables.get(p)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length() if n > 1 else 1)
        both = []
        for base in (p, pow(p, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            k = 1
            while k < size:
                out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            both.append(out)
        have = _tables[p] = (both[0], both[1])
    return have


@dataclass
class Words:
    """Words of a run of documents: ``ptr[i]:ptr[i + 1]`` are those of document i."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    h: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + SEGMENT)))
        lo, hi = int(start[i]), int(end[j - 1])
        pw, inv = powers(P_BYTE, hi - lo)
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=c[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (c[e] - c[s]) * inv[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = PLAIN, fold: np.ndarray | None = None, hashes: bool = True) -> Words:
    """Words (maximal runs of bytes of ``kind``) of the documents ``data[off[i]:off[i + 1]]``."""
    if fold is not None:
        data = fold[data]
    n = len(data)
    inside = kind[data] if n else np.zeros(0, bool)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts, lasts = off[:-1], off[1:]
    before[firsts[firsts < n]] = False
    after[lasts[lasts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    ptr = np.searchsorted(start, off)
    return Words(data, off, start, end, ptr, word_hashes(data, start, end) if hashes else np.zeros(0, np.uint64))


class Sequences:
    """Hashes of any ranges of words, from running sums."""

    def __init__(self, h: np.ndarray, p: int = P_ONE):
        self.pw, self.inv = powers(p, len(h) + 1)
        self.c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h if p == P_ONE else mix(h ^ np.uint64(p))) * self.pw[: len(h)], out=self.c[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.c[e] - self.c[s]) * self.inv[s] + (e - s).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every k consecutive words, whatever document they are in."""
        n = len(self.c) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.c[k:] - self.c[: n - k + 1]) * self.inv[: n - k + 1] + np.uint64(k))


def gram_starts(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Boolean over words: a k-gram that lies in one document starts here."""
    out = np.zeros(n, bool)
    if n:
        room = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(n)
        out = room >= k
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean over n places: inside any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d)[:n] > 0


def lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in the sorted ``table``, -1 where absent."""
    if not len(table) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)
