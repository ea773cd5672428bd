"""Vectorised words, word hashes and n-gram hashes over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Those bytes are
never part of a longer UTF-8 sequence, so a text can be cut on raw bytes. Texts
are handled in slices of about ``SLICE`` bytes, whole documents each, so that
the arrays stay small whatever an Arrow batch holds; one very long document
forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the hash functions, drawn once from a fixed seed.
_ODD = np.random.default_rng(20240607).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: _TAIL[n] keeps the low n bytes of a little-endian 64-bit load.
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def settle() -> None:
    """Give freed memory back to the system: workers live on between stages and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit; works in place on its own copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of documents ``first`` to ``last`` of a column, in order."""

    first: int
    last: int
    data: np.ndarray  # bytes of the slice
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    bounds: np.ndarray  # word index where each document begins, and the end
    offsets: np.ndarray  # byte offsets of the documents in data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """Index (from 0) of each word's document within the slice."""
        return np.repeat(np.arange(self.last - self.first), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        n = len(self.starts)
        return np.repeat(self.bounds[1:], self.counts) - np.arange(n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        lens = self.ends - self.starts
        h = mix(lens.astype(np.uint64) * _ODD[0])
        if not len(lens):
            return h
        pad = np.concatenate([self.data, np.zeros(8, np.uint8)])
        view = np.ndarray((len(self.data) + 1,), "<u8", pad.data, 0, (1,))
        at, left, live = self.starts.copy(), lens.copy(), None
        k = 1
        while True:
            part = view[at] & _TAIL[np.minimum(left, 8)]
            if live is None:
                h = mix((h ^ part) * _ODD[k])
            else:
                h[live] = mix((h[live] ^ part) * _ODD[k])
            more = left > 8
            if not more.any():
                return h
            live = np.flatnonzero(more) if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
            k = 1 + k % 60


def slices(column: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Words]:
    """The words of a string column, in slices of whole documents of about ``size`` bytes."""
    raw, off = texts(column)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        data = raw[off[first] : off[last]]
        if lower:
            data = _LOWER[data]
        offsets = off[first : last + 1] - off[first]
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Words(first, last, data, starts, ends, np.searchsorted(starts, offsets), offsets)
        first = last
    settle()


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the concatenation of what stands behind a and b."""
    return mix(a * _ODD[61] + b * _ODD[62])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from each position, by doubling: 1, 2, 4 ... and what is left over.

    The result has len(h) - n + 1 entries, none if h is shorter than n.
    """
    if len(h) < n:
        return h[:0]
    done, width, out = 0, 1, None
    part = h
    while True:
        if n & width:
            out = part if out is None else join(out[: max(0, len(h) - done - width + 1)], part[done : len(h) - width + 1])
            done += width
        if done == n:
            return out[: len(h) - n + 1]
        part = join(part[: len(part) - width], part[width:])
        width *= 2
