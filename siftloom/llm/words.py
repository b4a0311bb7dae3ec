"""Vectorised words and shingles over Arrow string columns.

A batch of texts is one UTF-8 byte buffer with document offsets.  Words are
found by a table over byte values and hashed by differences of one running
polynomial sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Byte values enter the sum through a fixed table of 64-bit words.
_TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=U64)
#: Words longer than this are hashed one by one (sums modulo 2**64 are weak on long regular strings).
LONG_WORD = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words ``[^\x20\x09-\x0D]+``.
BLANK = np.ones(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = {"p": np.ones(1, dtype=U64), "q": np.ones(1, dtype=U64)}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, at least ``n`` of each."""
    have = len(_powers["p"])
    if have < n:
        for k, base in (("p", _P), ("q", _PINV)):
            a = np.full(max(n, 1 << 20), base, dtype=U64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _powers[k] = a
    return _powers["p"][:n], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts take about ``max_bytes`` (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at, n = 0, b.num_rows
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + max_bytes, side="right"))
            to = min(max(to, at + 1), at + max_rows, n)
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


class Words:
    """The words of some documents: where each starts and ends, its hash, and each document's range."""

    def __init__(self, col: pa.Array, table: np.ndarray = BLANK):
        data, off = text_buffers(col)
        self.data, self.off = LOWER[data], off
        inside = table[self.data]
        n = len(inside)
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        prev = np.empty(n, dtype=bool)
        if n:
            prev[0] = False
            prev[1:] = inside[:-1]
        begins = inside & (~prev | first[:n])
        self.starts = np.flatnonzero(begins)
        ends = np.empty(n, dtype=bool)
        if n:
            ends[-1] = inside[-1]
            ends[:-1] = inside[:-1] & (~inside[1:] | first[1:n])
        self.ends = np.flatnonzero(ends) + 1
        #: Word range of document i: ``[doc[i], doc[i + 1])``.
        self.doc = np.searchsorted(self.starts, off)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, dtype=U64)
        p, q = _grow(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_TABLE[self.data] * p[:n], out=total[1:])
        h = mix((total[self.ends] - total[self.starts]) * q[self.starts])
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, and each document's range.

        A document of fewer words, but not none, has its whole sequence as one.
        """
        n, counts = len(self.hash), self.counts()
        if not n:
            return np.zeros(0, dtype=U64), np.zeros(len(counts) + 1, dtype=np.int64)
        h = np.zeros(n, dtype=U64)
        m = max(n - k + 1, 0)
        for j in range(k):
            h[:m] = mix(h[:m] + self.hash[j : j + m] + U64(j + 1))
        own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(own)])
        pick = np.repeat(self.doc[:-1] - bounds[:-1], own) + np.arange(bounds[-1])
        out = h[pick]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            v = np.zeros(1, dtype=U64)
            for j in range(counts[i]):
                v = mix(v + self.hash[self.doc[i] + j : self.doc[i] + j + 1] + U64(j + 1))
            out[bounds[i]] = mix(v + U64(1000 + counts[i]))[0]
        return out, bounds

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def segment_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty segments' numbers and starts, for ``reduceat``."""
    full = np.flatnonzero(np.diff(bounds))
    return full, bounds[full]
