"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins by quantiles of the training rows.
Boosting goes round the features again and again; each step fits a tree of depth
two to the residuals over one feature's bins and adds it, shrunk, to that
feature's lookup table.  Then the pairs of features whose 2 x 2 splits explain
most of what is left are boosted the same way over a grid of coarser bins.  A
score is the sum of one entry of each table, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches
from .words import BLANK, U64, Words, segment_starts, slices, text_buffers

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "digits", "upper", "non_ascii", "stops", "commas", "symbols", "pipes",
    "odd_words", "short_words", "long_words", "distinct_words", "top_word", "repeated_runs", "repeated_lines", "line_words", "sentence_words",
)


def _mask(chars: str | range) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return m


_LETTER = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {
    "letters": _LETTER, "digits": _mask("0123456789"), "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "non_ascii": _mask(range(0xC0, 0x100)),
    "stops": _mask(".!?"), "commas": _mask(",;:"), "symbols": _mask("#$%&*+/<=>@\\^_`{}~[]"), "pipes": _mask("|"),
}


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1)
    full, starts = segment_starts(bounds)
    if len(full):
        out[full] = np.add.reduceat(x.astype(np.float64), starts)
    return out


def _distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each range, and the count of the commonest."""
    n = len(bounds) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        doc = np.repeat(np.arange(n, dtype=U64), np.diff(bounds))
        key = np.sort((doc << U64(48)) | (h >> U64(16)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of = (key[new] >> U64(48)).astype(np.int64)
        distinct = np.bincount(of, minlength=n).astype(np.float64)
        np.maximum.at(top, of, np.diff(np.concatenate([new, [len(key)]])).astype(np.float64))
    return distinct, top


def features(col: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and empty texts give zeros."""
    raw, off = text_buffers(col)
    w = Words(col, BLANK)
    n_bytes, n_words = np.diff(off).astype(np.float64), w.counts().astype(np.float64)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    f = {"log_chars": np.log1p(n_bytes), "log_words": np.log1p(n_words)}
    for name, m in _CLASSES.items():
        f[name] = _sums(m[raw], off) / per_byte
    size = w.ends - w.starts
    f["word_length"] = _sums(size, w.doc) / per_word
    f["short_words"] = _sums(size <= 3, w.doc) / per_word
    f["long_words"] = _sums(size >= 14, w.doc) / per_word
    last = w.data[w.ends - 1] if len(size) else np.zeros(0, np.uint8)
    plain = _LETTER | _mask(range(0x80, 0x100)) | _mask(".,!?;:")
    f["odd_words"] = _sums(~plain[last], w.doc) / per_word
    distinct, top = _distinct(w.hash, w.doc)
    f["distinct_words"], f["top_word"] = distinct / per_word, top / per_word
    runs, bounds = w.shingles(5)
    n_runs = np.diff(bounds)
    f["repeated_runs"] = 1 - np.where(n_runs > 0, _distinct(runs, bounds)[0] / np.maximum(n_runs, 1), 1)
    lines = Words(col, np.arange(256) != 10)
    n_lines = lines.counts()
    f["repeated_lines"] = 1 - np.where(n_lines > 0, _distinct(lines.hash, lines.doc)[0] / np.maximum(n_lines, 1), 1)
    f["line_words"] = np.log1p(n_words / np.maximum(n_lines, 1))
    f["sentence_words"] = np.log1p(n_words / (1 + f["stops"] * n_bytes))
    return np.stack([f[k] for k in FEATURES], axis=1).astype(np.float32)


@dataclass(frozen=True)
class Params:
    """``max_rows``: the bounded sample of labelled rows, those with the smallest hash of the id."""

    max_rows: int = 30_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 8
    rate: float = 0.15
    min_rows: float = 5.0


@dataclass
class Model:
    """Lookup tables; a pair's table is indexed by the coarse bins of both features."""

    cuts: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> int | None:
    """The best place to cut ordered bins, or None."""
    if len(g) < 2:
        return None
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    gain[(cn < least) | (n.sum() - cn < least)] = -1
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Leaf values by bin of a tree of depth two over ordered bins."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        k = _split(g[a:b], h[a:b], n[a:b], least) if depth else None
        if k is None:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
        else:
            grow(a, a + k, depth - 1)
            grow(a + k, b, depth - 1)

    grow(0, len(g), 2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Best gain and values of a cut along one axis with a cut of its own on each side of the other."""
    best, values = -1.0, np.zeros(g.shape)
    for axis in (0, 1):
        a, b, c = (g, h, n) if axis == 0 else (g.T, h.T, n.T)
        for k in range(1, a.shape[0]):
            gain, v = 0.0, np.zeros(a.shape)
            for s in (slice(0, k), slice(k, None)):
                ga, hb, nc = a[s].sum(0), b[s].sum(0), c[s].sum(0)
                m = _split(ga, hb, nc, least) or 0
                for t in (slice(0, m), slice(m, None)):
                    gain += _gain(ga[t].sum(), hb[t].sum())
                    v[s, t] = ga[t].sum() / (hb[t].sum() + 1.0)
            if gain > best:
                best, values = gain, v if axis == 0 else v.T
    return best, values


def fit(x: np.ndarray, y: np.ndarray, p: Params | None = None) -> Model:
    """Fit to rows of features and labels 0/1; one class or none gives a constant."""
    p = p or Params()
    x, y = np.asarray(x, dtype=np.float32).reshape(-1, len(FEATURES)), np.asarray(y, dtype=np.float64)
    k = x.shape[1]
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 2 or y.min() == y.max():
        return Model([np.zeros(0, np.float32)] * k, [np.zeros(0, np.float32)] * k, float(np.log(rate / (1 - rate))), [np.zeros(1)] * k)
    cuts, coarse = [_cuts(x[:, j], p.bins) for j in range(k)], [_cuts(x[:, j], p.pair_bins) for j in range(k)]
    at = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(k)]
    model = Model(cuts, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(c) + 1) for c in cuts])
    z = np.full(len(y), model.intercept)
    n = [np.bincount(at[j], minlength=len(cuts[j]) + 1).astype(float) for j in range(k)]
    for _ in range(p.rounds):
        for j in range(k):
            q = 1 / (1 + np.exp(-z))
            size = len(cuts[j]) + 1
            step = p.rate * _tree(np.bincount(at[j], y - q, size), np.bincount(at[j], q * (1 - q), size), n[j], p.min_rows)
            model.tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(k)]
    shape = [len(c) + 1 for c in coarse]

    def grid(i: int, j: int):
        cell, size = low[i] * shape[j] + low[j], shape[i] * shape[j]
        q = 1 / (1 + np.exp(-z))
        return [np.bincount(cell, v, size).reshape(shape[i], shape[j]) for v in (y - q, q * (1 - q), np.ones(len(y)))]

    ranked = sorted(((_quadrants(*grid(i, j), p.min_rows)[0], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[: p.pairs]]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(p.pair_rounds):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            step = p.rate * _quadrants(*grid(i, j), p.min_rows)[1]
            t += step
            z += step[low[i], low[j]]
    return model


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each text (array of floats)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column(1))
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<float>")


def held_out() -> F.Column:
    """Rows that labels are never learned from: CRC-32 of the id as text leaves 2 over 4 (null: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model:
    """Fit on labelled rows of ``docs(doc_id, text)`` outside the held-out part.

    ``labels(doc_id, quality)``: null labels are ignored, several labels of one
    id give their mean, rounded up.  At most ``max_rows`` rows, the smallest by
    a hash of the id, are read and come to the driver; their ids are chosen
    before any text is read.
    """
    p = p or Params()
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.ceil(F.avg(F.col("quality").cast("double"))).cast("int").alias("quality"))
    h = F.xxhash64("doc_id").alias("h")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).join(one.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id")
    chosen = F.broadcast(materialise(ids.orderBy(h, "doc_id").limit(p.max_rows).distinct(), "chosen"))  # max_rows rows at most
    feats = document_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id"), "doc_id", "left_semi"))
    rows = feats.join(chosen, "doc_id").select("features", "quality", h, "doc_id").orderBy("h", "doc_id").limit(p.max_rows).collect()
    return fit(np.array([r.features for r in rows], dtype=np.float32), np.array([r.quality for r in rows], dtype=float), p)


def classify(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.value.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay.  Texts are scored where they lie."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.value.score(features(b.column(b.schema.get_field_index("text"))))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
