"""Language-model scores from a probabilistic suffix tree over word symbols.

A word is its own symbol if its training tokens reach ``symbol_count`` (or
``symbol_share`` of all, if that is fewer); other words are gathered by their last
bytes, and by one common symbol where an ending is rare too.  A word's probability
is its symbol's in the current state of the tree times its add-one share within
the symbol.

The tree's contexts are the last one to ``depth`` symbols of the document.  They
are grown level by level: a context is counted if it occurs ``context_count``
times in training, and retained if its next-symbol distribution diverges from that
of the next shorter one by ``divergence`` nats over its occurrences, each left out
in turn.  Distributions are smoothed by the shorter context's; a symbol is scored
in the longest retained suffix state.  Least counts are absolute, so symbols and
contexts grow with the corpus: a passage that occurs twice is remembered.

The texts are tokenised once, into blocks of some megabytes: one row with the
places of its tokens in the block's list of distinct words.  Words and, level by
level, contexts are counted by exchange: a block sends its distinct ones, with
their counts, to parts by hash, as a few packed arrays; a part sums what all
blocks sent and answers each in the order of its question.  No process holds the
tree, a part's size is bounded, and a frequent word or context comes to a part
once a block.  Leaving each occurrence out, a context none of whose successors
occurs twice can't be retained, so nothing but that is answered about it.  Workers
share an executor's memory with its heap: arrays over a block's tokens are narrow,
few at a time, and given back after each block.

Words and contexts are told apart by 64-bit hashes, the contexts within a part by
48 bits and the successors of one context by 32; the divergence test knows the
shorter context's probabilities to 1/1024 of a decade.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise, small_batches
from .words import BLANK, U64, Words, slices
from .words import mix as scramble

#: Symbols besides those of words.
START, END, OTHER = 0, 1, 2
_DECADE = 1024
#: Tokens in one step of arithmetic over a block's tokens.
_STEP = 1 << 17
#: Text tokenised at once on the way to a block.
_SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class Params:
    """``ending``: bytes of the endings (1 to 3); ``pull``: weight of the shorter context; ``block_bytes``: text in one block; ``part_rows``: words or tokens for each part of an exchange."""

    depth: int = 3
    symbol_count: int = 64
    symbol_share: float = 3e-4
    context_count: int = 2
    ending: int = 3
    divergence: float = 6.0
    pull: float = 5.0
    block_bytes: int = 8 << 20
    part_rows: int = 1_500_000

    def __post_init__(self):
        if self.depth < 1 or not 1 <= self.ending <= 3 or self.context_count < 2 or self.symbol_count < 1 or not 0 < self.symbol_share <= 1 or self.pull <= 0 or min(self.block_bytes, self.part_rows) < 1:
            raise ValueError(f"parameters out of range: {self}")


def held_out() -> F.Column:
    """Rows never learned from: CRC-32 of the id as text leaves 2 over 7 (null: learned from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return (text or "").encode().lower().split()


# --- packed arrays ---


def pack(a: np.ndarray, dtype, width: int | None = None) -> bytes:
    """The lowest ``width`` bytes of each number, all first bytes first, compressed."""
    a = np.ascontiguousarray(a, dtype=dtype)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(data: bytes, dtype, width: int | None = None) -> np.ndarray:
    dtype = np.dtype(dtype)
    width = width or dtype.itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], dtype.itemsize), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(dtype)


def together(parts: list[bytes], dtype, width: int | None = None) -> np.ndarray:
    return np.concatenate([*(unpack(x, dtype, width) for x in parts), np.zeros(0, dtype)])


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    kind = lambda t: pa.list_(_TYPES[t[6:-1]]) if t.startswith("array<") else _TYPES[t]
    return pa.schema([(name, kind(t)) for name, t in (x.split() for x in ddl.split(", "))])


def _row(values, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


def mix(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts (or symbols) followed by symbols."""
    return scramble(key.astype(U64) * U64(0x9E3779B97F4A7C15) + symbol.astype(U64))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((scramble(key) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def _new(a: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array differs from the one before."""
    out = np.ones(len(a), dtype=bool)
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, for each of them a place where it occurs, and each place's number among them.

    As ``np.unique``, with fewer arrays at once.
    """
    order = np.argsort(a)
    a = a[order]
    new = _new(a)
    a = a[new]
    inv = np.empty(len(order), dtype=np.int32)
    inv[order] = np.cumsum(new, dtype=np.int32)
    inv -= 1
    return a, order[new], inv


def _paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = high.astype(np.int64)
    out <<= 32
    out |= low
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def release() -> None:
    """Give the system what arrays have freed: else a worker keeps its peak through all later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ranges(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())


# --- blocks of documents ---

_BLOCK = "block long, doc_id array<long>, held array<boolean>, size array<long>, learned_docs long, learned_tokens long, tokens long, words long, codes binary, places binary, hash binary, ending binary, learned binary"


def _endings(w: Words, n: int) -> np.ndarray:
    """The last ``n`` bytes of each word, and how many there are."""
    size = w.ends - w.starts
    out = (np.minimum(size, n) << 24).astype(np.uint32)
    for j in range(n):
        out |= np.where(j < size, w.data[np.maximum(w.ends - 1 - j, 0)].astype(np.uint32) << np.uint32(8 * j), np.uint32(0)) if len(size) else out
    return out


def blocks_of(docs: DataFrame, p: Params) -> DataFrame:
    """A row for each run of documents of ``docs(doc_id, text, held_out)``.

    ``codes``: for each token the rank of its word by frequency in the block;
    ``places``: for each rank the place in the sorted ``hash``; ``learned``: the
    word's training tokens in the block.
    """
    schema = _arrow(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, held, size, hashes, ends, held_bytes = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.concatenate(hashes), np.concatenate(size)
            hashes.clear()
            keep = ~np.array(held, dtype=bool)
            words, at, inv = distinct(h)
            learned = np.bincount(inv[np.repeat(keep, n)], minlength=len(words))
            places = np.argsort(-np.bincount(inv, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.uint32)
            rank[places] = np.arange(len(words), dtype=np.uint32)
            row = [number, ids.copy(), held.copy(), n, int(keep.sum()), int(n[keep].sum()), len(h), len(words), pack(rank[inv], np.uint32), pack(places, np.uint32), pack(words, U64), pack(np.concatenate(ends)[at], np.uint32), pack(learned, np.uint32)]
            return _row(row, schema)

        for b in slices(batches, max_bytes=_SLICE_BYTES):
            w = Words(b.column(1), BLANK)
            ids += b.column(0).to_pylist()
            held += b.column(2).to_pylist()
            size.append(w.counts())
            hashes.append(w.hash)
            ends.append(_endings(w, p.ending))
            held_bytes += len(w.data)
            if held_bytes >= p.block_bytes:
                yield flush()
                number, held_bytes = number + 1, 0
                for x in (ids, held, size, hashes, ends):
                    x.clear()
                release()
        if ids:
            yield flush()
        release()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, _BLOCK)


def exchange(rows: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """``answer`` of all rows that have come to one part, for every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from answer(pa.Table.from_batches(got))
        release()

    return rows.repartitionById(parts, "part").mapInArrow(run, schema)


def parts_for(rows: int, p: Params, usual: int) -> int:
    return max(1, -(-rows // p.part_rows), min(usual, -(-rows // 100_000)))


def _pieces(part: np.ndarray) -> list[tuple[int, int, int]]:
    """Part, start and end of each run of a sorted array of parts."""
    at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    if not at:
        return []
    return [(int(part[s]), s, e) for s, e in zip(at, [*at[1:], len(part)], strict=True)]


# --- words ---

_WORDS = "block long, part int, hash binary, ending binary, learned binary"
_COUNTS = "block long, part int, n binary, e binary, en binary, ev binary, types long"


def word_counts(blocks: DataFrame, parts: int, least: float) -> DataFrame:
    """Of each block and part the training tokens of its words; and of each part (block null) those and the words of endings, over words below ``least``, and the distinct words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, h, e, n in zip(*(b.column(c).to_pylist() for c in ("block", "hash", "ending", "learned")), strict=True):
                h, e, n = unpack(h, U64), unpack(e, np.uint32), unpack(n, np.uint32)
                part = part_of(h, parts)
                order = np.argsort(part, kind="stable")
                h, e, n = h[order], e[order], n[order]
                for k, s, t in _pieces(part[order]):
                    yield _row((block, k, pack(h[s:t], U64), pack(e[s:t], np.uint32), pack(n[s:t], np.uint32)), asked)

    asked, told = _arrow(_WORDS), _arrow(_COUNTS)

    def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hs = [unpack(x, U64) for x in t.column("hash").to_pylist()]
        words, at, inv = distinct(np.concatenate(hs))
        n = np.bincount(inv, together(t.column("learned").to_pylist(), np.uint32), len(words)).astype(np.int64)
        end = together(t.column("ending").to_pylist(), np.uint32)[at]
        rare = (n > 0) & (n < least)
        e, of = np.unique(end[rare], return_inverse=True)
        own = pack(e, np.uint32), pack(np.bincount(of, n[rare], len(e)), np.int64), pack(np.bincount(of, minlength=len(e)), np.int64)
        yield _row((None, None, None, *own, int((n > 0).sum())), told)
        s = 0
        for block, part, h in zip(t.column("block").to_pylist(), t.column("part").to_pylist(), hs, strict=True):
            yield _row((block, part, pack(n[inv[s : s + len(h)]], np.int64), None, None, None, None), told)
            s += len(h)

    return exchange(blocks.select("block", "hash", "ending", "learned").mapInArrow(ask, _WORDS), parts, answer, _COUNTS)


def ending_counts(counts: DataFrame) -> DataFrame:
    """(e, n, v): training tokens and words below the least count of each ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, n, v = together(b.column(0).to_pylist(), np.uint32), together(b.column(1).to_pylist(), np.int64), together(b.column(2).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int64)), pa.array(n), pa.array(v)], names=["e", "n", "v"])

    rows = counts.where("block is null").select("e", "en", "ev").mapInArrow(run, "e long, n long, v long")
    return rows.groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


# --- symbols ---

_CODED = "block long, doc_id array<long>, held array<boolean>, size array<long>, known array<long>, base array<double>, within array<double>, ids binary, names binary, roots binary"


@dataclass(frozen=True)
class Root:
    """What symbols need of all words: ``big``, ``mass``: frequent endings in order, with their add-one mass; ``rest``: the mass of the common symbol; ``total``: of all; ``documents``, ``tokens``, ``types``: of the training part."""

    big: np.ndarray
    mass: np.ndarray
    rest: float
    total: float
    documents: int
    tokens: int
    types: int
    least: float


def encode(blocks: DataFrame, counts: DataFrame, parts: int, root: Root) -> DataFrame:
    """Blocks with symbols for words: ``ids`` are ranks in ``names``, ``roots`` the root's log10 probabilities; each document ends in END."""
    schema = _arrow(_CODED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = one(left, right) if left.num_rows else schema.empty_table()
        release()
        return out

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        h, end = unpack(row["hash"], U64), unpack(row["ending"], np.uint32)
        n = np.empty(len(h), dtype=np.int64)
        right = right.sort_by("part")
        n[np.argsort(part_of(h, parts), kind="stable")] = together(right.column("n").to_pylist(), np.int64)
        i = np.minimum(np.searchsorted(root.big, end), max(len(root.big) - 1, 0))
        gathered = (root.big[i] == end) if len(root.big) else np.zeros(len(h), dtype=bool)
        frequent = n >= root.least
        symbol = np.where(frequent, h, np.where(gathered, scramble(end.astype(U64) + U64(1 << 40)), U64(OTHER)))
        mass = np.where(frequent, n + 2.0, np.where(gathered, root.mass[i] if len(root.big) else 0.0, root.rest))
        place = unpack(row["places"], np.uint32)[unpack(row["codes"], np.uint32)]
        size = np.array(row["size"], dtype=np.int64)
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        inner = np.ones(len(place) + len(size), dtype=bool)
        inner[ends] = False

        def each(of_word: np.ndarray, of_end: float) -> np.ndarray:
            x = np.full(len(inner), of_end, dtype=np.float64)
            x[inner] = of_word[place]
            return np.add.reduceat(x, starts)

        names, at, kind = np.unique(np.concatenate([symbol, [U64(END)]]), return_index=True, return_inverse=True)
        ids = np.full(len(inner), kind[-1])
        ids[inner] = kind[place]
        order = np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), dtype=np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        base = np.log10(n + 1.0)
        known = each((n > 0).astype(float), float(root.documents > 0)).astype(np.int64)
        low = each(base, np.log10(root.documents + 1)) - (size + 1) * np.log10(root.tokens + root.types + 1)
        roots = np.log10(np.concatenate([mass, [root.documents + 1]])) - np.log10(root.total)
        out = [row["block"], row["doc_id"], row["held"], size + 1, known, low, each(base - np.log10(mass), 0.0), pack(rank[ids], np.uint32), pack(names[order], U64), pack(roots[at][order], np.float64)]
        return pa.Table.from_batches([_row(out, schema)])

    answers = counts.where("block is not null").select("block", "part", "n")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _CODED)


# --- levels of the tree ---

_ASKED = "block long, part int, context binary, width binary, symbol binary, n binary, up binary"
_ANSWER = "block long, level int, part int, state binary, total binary, n binary"
#: Of a context: no successor occurs twice; one does; its distribution is retained.
_PLAIN, _COUNTED, _RETAINED = 0, 1, 2


def walk(row: dict, answers: Sequence[dict[str, np.ndarray]], parts: int, p: Params, ask: bool = True) -> tuple[np.ndarray, list[tuple] | None]:
    """log10 probabilities of a block's symbols in the longest contexts that ``answers`` retain, and (with ``ask``) what the block asks about the next longer ones."""
    ids, names = unpack(row["ids"], np.uint32), unpack(row["names"], U64)
    logp = unpack(row["roots"], np.float64)[ids]
    size = np.array(row["size"], dtype=np.int64)
    starts = np.cumsum(size) - size
    inside = np.ones(len(ids), dtype=bool)
    inside[starts] = False
    learned = np.repeat(~np.array(row["held"], dtype=bool), size)
    at, key = np.arange(len(ids), dtype=np.int32), np.append(names, U64(START))
    context = np.empty(len(ids), dtype=np.uint32)
    context[1:] = ids[:-1]
    context[starts] = len(names)
    for level in range(len(answers) + ask):
        pair, some, inv = distinct(_paired(context, ids[at]))
        of, rank = (pair >> 32).astype(np.uint32), pair.astype(np.uint32)
        del context, pair
        new = _new(of)
        first = np.flatnonzero(new)
        width = np.diff(first, append=len(of))
        part = part_of(key[of[first]], parts)
        order = np.argsort(part, kind="stable")
        if level == len(answers):
            n = np.bincount(inv[learned[at]], minlength=len(of))
            # all places of a pair have one probability
            some = at[some]
            del inv, at
            rows = []
            for k, s, e in _pieces(part[order]):
                c = order[s:e]
                r = ranges(first[c], width[c])
                rows.append((row["block"], k, pack(key[of[first[c]]], U64, 6), pack(width[c], np.uint32), pack(names[rank[r]], U64, 4), pack(n[r], np.uint32), pack(np.rint(np.maximum(logp[some[r]] * -_DECADE, 0)), np.uint16)))
            return logp, rows
        del some
        got = answers[level]
        state, total = np.empty(len(first), dtype=np.uint8), np.zeros(len(first))
        state[order] = got["state"]
        total[order[got["state"] == _RETAINED]] = got["total"]
        c = order[got["state"] != _PLAIN]
        n = np.zeros(len(of))
        n[ranges(first[c], width[c])] = got["n"]
        del got, c, order, part, first, width
        group = np.cumsum(new, dtype=np.int32)
        group -= 1
        for s in range(0, len(at), _STEP):
            j = inv[s : s + _STEP]
            kept = state[group[j]] == _RETAINED
            i, j = at[s : s + _STEP][kept], j[kept]
            logp[i] = np.log10((n[j] + p.pull * np.power(10.0, logp[i])) / (total[group[j]] + p.pull))
        often = (n >= p.context_count)[inv]
        del n, new, group, state, total
        following = at[often] + 1
        here = (following < len(ids)) & inside[np.minimum(following, len(ids) - 1)]
        at, context = following[here], inv[often][here]
        del inv, often, following, here
        shorter, key = key, np.empty(len(of), dtype=U64)
        for s in range(0, len(of), _STEP):
            key[s : s + _STEP] = mix(shorter[of[s : s + _STEP]], names[rank[s : s + _STEP]])
        del shorter, of, rank
    return logp, None


def judge(t: pa.Table, level: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Answers about the contexts of one part: their states, training occurrences of retained ones, and those of the pairs of all but plain ones."""
    widths = [unpack(x, np.uint32).astype(np.int64) for x in t.column("width").to_pylist()]
    width = np.concatenate(widths)
    keys, _, of = distinct(together(t.column("context").to_pylist(), U64, 6))
    pair, some, inv = distinct(_paired(np.repeat(of, width), together(t.column("symbol").to_pylist(), U64, 4).astype(np.uint32)))
    n = np.bincount(inv, together(t.column("n").to_pylist(), np.uint32), len(pair))
    up = np.power(10.0, together(t.column("up").to_pylist(), np.uint16)[some] / -_DECADE)
    c = pair >> 32
    del pair, some
    total = np.bincount(c, n, len(keys))
    # of each occurrence against a distribution from the others: rare successors of rare contexts prove nothing
    gain = np.bincount(c, n * np.log((np.maximum(n - 1, 0) + p.pull * up) / ((np.maximum(total, 1)[c] - 1 + p.pull) * up)), len(keys))
    counted = np.bincount(c, n >= 2, len(keys)) > 0
    state = np.where(counted, np.where(gain >= p.divergence, _RETAINED, _COUNTED), _PLAIN).astype(np.uint8)
    told = _arrow(_ANSWER)
    s = r = 0
    for block, part, w in zip(t.column("block").to_pylist(), t.column("part").to_pylist(), widths, strict=True):
        mine, pairs = of[s : s + len(w)], inv[r : r + w.sum()]
        s, r = s + len(w), r + int(w.sum())
        st = state[mine]
        yield _row((block, level, part, pack(st, np.uint8), pack(total[mine][st == _RETAINED], np.int64), pack(n[pairs][np.repeat(st != _PLAIN, w)], np.int64)), told)


class Answers(Sequence):
    """What parts have answered a block, unpacked level by level as it is asked for."""

    def __init__(self, right: pa.Table, levels: int):
        self.right, self.levels = right.sort_by([("level", "ascending"), ("part", "ascending")]), levels

    def __len__(self) -> int:
        return self.levels

    def __getitem__(self, d: int) -> dict[str, np.ndarray]:
        mine = self.right.filter(pa.array(self.right.column("level").to_numpy() == d))
        return {c: together(mine.column(c).to_pylist(), k) for c, k in (("state", np.uint8), ("total", np.int64), ("n", np.int64))}


def score_documents(docs: DataFrame, p: Params | None = None, hold: F.Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from rows of ``docs(doc_id, text)`` that ``hold`` doesn't hold out.
    Null text is empty: one token, the end.  Rows of one id, and repeated rows,
    are documents of their own.  Scores are log10.  With no training rows the
    base and the tree are uniform.  Other columns are not used.
    """
    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialise(blocks_of(d.withColumn("held_out", held_out() if hold is None else F.coalesce(hold, F.lit(False))), p), "blocks")
    stat = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("learned_docs", "learned_tokens", "tokens", "words")]).first()
    documents, n = int(stat.learned_docs), int(stat.learned_tokens) + int(stat.learned_docs)
    least = min(p.symbol_count, p.symbol_share * max(n, 1))

    parts = parts_for(int(stat.words), p, usual)
    counts = materialise(word_counts(blocks, parts, least), "word-counts")
    ends = materialise(ending_counts(counts), "endings")
    # an ending has few bytes, so the number of frequent ones is bounded whatever the corpus
    big = ends.where(F.col("n") >= least).orderBy("e").toArrow()
    low = ends.where(F.col("n") < least).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    rare = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    types = int(counts.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("t")).first().t)
    mass = (big.column("n").to_numpy() + big.column("v").to_numpy() + 1).astype(np.float64)
    rest = float(low.n + low.v + 1)
    # tokens and words, and one for words not seen, of each symbol
    own = int(stat.learned_tokens) - int(rare.n) + 2 * (types - int(rare.v))
    total = own + rest + float(mass.sum()) + documents + 1
    root = Root(big.column("e").to_numpy().astype(np.uint32), mass, rest, total, documents, n, types + int(documents > 0), least)
    coded = materialise(encode(blocks, counts, parts, root), "coded")
    discard(blocks, counts, ends)

    parts = parts_for(int(stat.tokens), p, usual)
    state = spark.createDataFrame([], _ANSWER)
    asked = _arrow(_ASKED)

    def asking(level: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = walk(left.to_pylist()[0], Answers(right, level), parts, p)[1] if left.num_rows else []
            release()
            return pa.Table.from_batches([_row(r, asked) for r in rows], schema=asked)

        return ask

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = walk(row, [], parts, p)[1]
                release()
                yield from (_row(r, asked) for r in rows)

    for level in range(p.depth):
        rows = coded.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(asking(level), _ASKED) if level else coded.mapInArrow(first, _ASKED)
        state = state.unionByName(materialise(exchange(rows, parts, lambda t, level=level: judge(t, level, p), _ANSWER), "answers"))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = _arrow(schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        row = left.to_pylist()[0]
        logp = walk(row, Answers(right, p.depth), parts, p, ask=False)[0]
        size = np.array(row["size"], dtype=np.int64)
        sums = np.add.reduceat(logp, np.cumsum(size) - size) + np.array(row["within"])
        cols = [row["doc_id"], row["held"], size, row["known"], np.full(len(size), n), row["base"], sums]
        del logp
        release()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, out, strict=True)], schema=out)

    return coded.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(score, schema)
