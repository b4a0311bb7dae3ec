"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The words of benchmark items (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z) give windows of ``window`` consecutive words; an item with
fewer words, but not none, is one window.  Windows of one length L make one
machine:

* SHIFT table, indexed by a hash of a block of two words: how far the search may
  move on before any window can end, L - 1 for blocks that occur in no window;
* bucket, for blocks with shift 0, which close some window: test strings are
  looked up there by a hash of their L words;
* direct comparison of the words' bytes, which confirms.

A slice of documents is searched in lanes that move on together, so the tables
are read once for each stop and not once for each word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import filesystem, scratch, small_batches, write_atomic
from .words import ALNUM, U64, Words, mix, slices

#: Benchmark words in one block of machines; beyond it, tasks load blocks from the shared folder one at a time.
BLOCK_WORDS = 1_000_000
_LANE = 384


def _sequence_hash(h: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words up to each end, from 64-bit word hashes."""
    out = np.zeros(len(ends), dtype=U64)
    for j in range(length):
        out = mix(out + h[ends - (length - 1) + j])
    return out


class Machine:
    """The tables for all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        words = sorted(windows)
        flat = pa.array([" ".join(x.decode("utf-8") for x in w) for w in words], pa.large_string())
        h = Words(flat, ALNUM).hash.reshape(len(words), length)
        self.bits = max(8, int(np.ceil(np.log2(8 * h.size + 1))))
        self.shift = np.full(1 << self.bits, length - self.block + 1, dtype=np.int32)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, self._index(h[:, j - 1] if self.block == 2 else None, h[:, j]), length - 1 - j)
        keys = _sequence_hash(h.reshape(-1), np.arange(len(words)) * length + length - 1, length)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.words = [words[i] for i in order]
        self.items = [sorted(windows[words[i]]) for i in order]

    def _index(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        x = last if before is None else before * U64(0x9E3779B97F4A7C15) + last
        return (mix(x) >> U64(64 - self.bits)).astype(np.int64)

    def stops(self, h: np.ndarray) -> np.ndarray:
        """Positions where a window may end: those with shift 0 that the search meets."""
        n, first = len(h), self.length - 1
        if n <= first:
            return np.zeros(0, dtype=np.int64)
        pos = np.arange(first, n, _LANE)
        end = np.minimum(pos + _LANE, n)
        found = []
        while len(pos):
            s = self.shift[self._index(h[pos - 1] if self.block == 2 else None, h[pos])]
            if (zero := pos[s == 0]).size:
                found.append(zero)
            pos = pos + np.maximum(s, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last word and window number of each confirmed occurrence."""
        e = self.stops(w.hash)
        if not e.size:
            return e, e
        doc = np.searchsorted(w.doc, e, side="right")  # the window may not reach into the document before
        e = e[e - self.length + 1 >= w.doc[doc - 1]]
        key = _sequence_hash(w.hash, e, self.length)
        at = np.searchsorted(self.keys, key)
        ends, which = [], []
        for pos, k, i in zip(e.tolist(), key.tolist(), at.tolist(), strict=True):
            while i < len(self.keys) and int(self.keys[i]) == k:
                if all(w.word(pos - self.length + 1 + j) == x for j, x in enumerate(self.words[i])):
                    ends.append(pos)
                    which.append(i)
                i += 1
        return np.array(ends, dtype=np.int64), np.array(which, dtype=np.int64)


def compile_items(items: list[tuple[str | None, str | None]], window: int) -> list[Machine]:
    """Machines for a list of (item_id, text).  An item without id marks words but is not reported."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    w = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
    for k, (item, _) in enumerate(items):
        words = [w.word(i) for i in range(w.doc[k], w.doc[k + 1])]
        for i in range(max(len(words) - window + 1, 1) if words else 0):
            win = tuple(words[i : i + window])
            got = by_length.setdefault(len(win), {}).setdefault(win, set())
            if item is not None:
                got.add(item)
    return [Machine(n, by_length[n]) for n in sorted(by_length)]


def _blocks(items: DataFrame, window: int):
    """A function for tasks that yields lists of machines, and how many there are.

    The items come to the driver block by block; a block is bounded by
    ``BLOCK_WORDS`` words and one item.  One block is broadcast, more are
    written to the shared folder.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    n_words = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(n_words) // (6 * BLOCK_WORDS)))
    if n == 1:
        shared = spark.sparkContext.broadcast(compile_items([(r.item_id, r.text) for r in items.collect()], window))
        return lambda: [shared.value], 1
    names = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        names.append(uri := scratch(spark, f"windows-{k}"))
        write_atomic(uri, [pickle.dumps(compile_items([(r.item_id, r.text) for r in part], window))])

    def load():
        for uri in names:
            f, path = filesystem(uri)
            with f.open_input_file(path) as src:
                yield pickle.loads(src.read())

    return load, n


def find_windows(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """Add to each row of ``docs`` what it shares with the windows of ``items(item_id, text)``.

    New columns (replacing any of the names): ``n_words`` long; ``spans``, the
    maximal runs of hit words as structs of first word and word after the last;
    ``items``, the ids as strings, sorted, of items with a window that occurs.
    Null or empty text has no words and no hits; an empty ``items`` hits nothing.
    Rows are independent: no shuffle, and repeated rows stay.
    """
    small_batches(docs.sparkSession)
    names = ["n_words", "spans", "items"]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    load, n_blocks = _blocks(items, window)
    a_span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, max_bytes=(2 if n_blocks == 1 else 8) << 20):
            w = Words(b.column(b.schema.get_field_index(text_col)), ALNUM)
            edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
            named: dict[int, set[str]] = {}
            for machines in load():
                for m in machines:
                    ends, which = m.occurrences(w)
                    if not ends.size:
                        continue
                    np.add.at(edge, ends - m.length + 1, 1)
                    np.add.at(edge, ends + 1, -1)
                    doc = np.searchsorted(w.doc, ends, side="right") - 1
                    for d, k in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                        named.setdefault(d, set()).update(m.items[k])
            hit = np.cumsum(edge[:-1]) > 0
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            if hit.any():
                change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
                    d = int(np.searchsorted(w.doc, s, side="right")) - 1
                    while s < e:  # a run may go on in the next document
                        to = min(e, int(w.doc[d + 1]))
                        if to > s:
                            spans[d].append({"start": s - int(w.doc[d]), "stop": to - int(w.doc[d])})
                        s, d = max(to, s), d + 1
            found = [sorted(named.get(d, ())) for d in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w.counts(), pa.int64()), pa.array(spans, pa.list_(a_span)), pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def verdicts(found: DataFrame, ratio: int = 20) -> DataFrame:
    """Add n_hit, n_items and contaminated: hit words are at least one in ``ratio``."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ratio) * F.col("n_hit") >= F.col("n_words")))
