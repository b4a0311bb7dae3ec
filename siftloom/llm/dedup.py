"""Near-duplicate detection with MinHash bands and odd sketches.

A document's set holds the hashes of its distinct runs of ``shingle`` words.
From it come ``k`` MinHash samples, whose bands of ``rows`` samples are bucket
keys, and an odd sketch: a bitmap in which every sample toggles one bit.  The
XOR of two sketches has, for similarity J, about ``n/2 (1 - exp(-4k(1-J)/n))``
ones, so its population count estimates high similarities precisely.  A second
bitmap takes the parity of all hashes of the set: its XOR has at most as many
ones as the sets' symmetric difference has members, so too many ones prove that
a pair is no link.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Bucket leaders: each document meets the smallest id of each of its buckets;
   pairs whose sketches rule out the threshold by ``margin`` go, and each
   document's best pairs are confirmed on the full sets.  These links already join
   almost all of a large group, with few pairs per document.
3. Components of the links label the documents.  Buckets that still hold several
   labels are searched exactly: every pair of different labels is compared by
   sketches, in blocks, and what passes is confirmed on the full sets.  So no
   link between components is lost, while pairs inside one are never made.
4. Components of all links give each document its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import discard, materialise, small_batches
from .words import BLANK, U64, Words, mix, segment_starts, slices


@dataclass(frozen=True)
class Params:
    """``threshold``: links have 100 * intersection >= 100 * threshold * union.

    With 32 bands of 5 rows a pair at 0.8 shares no bucket with probability
    (1 - 0.8**5)**32 = 3e-6.  ``margin`` is six standard deviations of the
    sketch's estimate at 0.8 (160 samples, 512 bits).  ``block``: documents of
    one side of a block of the exact search.  ``leaders``: pairs of each document
    that are tried before it.
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    bits: int = 512
    margin: float = 0.2
    block: int = 2048
    parity_bits: int = 1024
    leaders: int = 3

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_ones(self) -> int:
        """Ones in the XOR of two sketches that still allow the threshold."""
        j = max(self.threshold - self.margin, 0.0)
        return math.ceil(self.bits / 2 * (1 - math.exp(-4 * self.samples * (1 - j) / self.bits)))


def _constants(p: Params) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 31, p.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, p.samples, dtype=np.uint32)


def distinct_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, concatenated, and their ranges."""
    h, bounds = w.shingles(k)
    parts = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    out = np.concatenate([*parts, np.zeros(0, dtype=U64)])
    return out, np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and both sketches (one array of longs).

    Null or empty text has an empty set: digest, bands and sketch are null.
    """
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    a, c = _constants(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, bounds = distinct_sets(Words(b.column(1), BLANK), p.shingle)
            n = np.diff(bounds)
            full, starts = segment_starts(bounds)
            x = (flat >> U64(32)).astype(np.uint32)
            low = np.empty((p.samples, len(full)), dtype=np.uint32)
            for i in range(p.samples if len(full) else 0):
                low[i] = np.minimum.reduceat(x * a[i] + c[i], starts)
            keys = np.zeros((p.bands, len(full)), dtype=U64)
            for i in range(p.samples):
                j = i // p.rows
                keys[j] = mix(keys[j] + low[i].astype(U64) + (U64(j + 1) << U64(40)))
            spot = (mix(low.astype(U64) + (np.arange(p.samples, dtype=U64)[:, None] << U64(32))) % U64(p.bits)).astype(np.int64)
            ones = np.zeros((len(full), p.bits), dtype=np.uint8)
            for i in range(p.samples):
                ones[np.arange(len(full)), spot[i]] ^= 1
            bit = (mix(flat + U64(77)) % U64(p.parity_bits)).astype(np.int64)
            own = np.repeat(np.arange(len(full)), n[full])
            parity = (np.bincount(own * p.parity_bits + bit, minlength=len(full) * p.parity_bits) & 1).astype(np.uint8).reshape(len(full), p.parity_bits)
            sketch = np.packbits(np.concatenate([ones, parity], axis=1), axis=1).view("<i8")
            some = np.zeros(b.num_rows, dtype=bool)
            some[full] = True
            digest = [None] * b.num_rows
            for i in full.tolist():
                digest[i] = xxhash.xxh3_128_digest(flat[bounds[i] : bounds[i + 1]].tobytes())

            def lists(m: np.ndarray) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(some) * m.shape[1]]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)), mask=pa.array(~some))

            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(digest, pa.binary()), lists(keys.T), lists(sketch)], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id and the sorted set as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, bounds = distinct_sets(Words(b.column(1), BLANK), p.shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    ``a`` may be one document of a large group: Spark splits the side with many
    rows of one key and copies the one set to each part.
    """
    num = round(100 * p.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices([big], "x", max_bytes=32 << 20):
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                    u = np.concatenate([s, t])
                    u.sort()
                    both = int(np.count_nonzero(u[1:] == u[:-1]))
                    keep.append(100 * both >= num * (len(u) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ones(x: str, y: str, start: int, bits: int):
    """Population count of the XOR of two arrays of longs, from long ``start`` on."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(start, start + bits // 64)), F.lit(0))


def _cross(members: DataFrame, p: Params) -> DataFrame:
    """All pairs of one bucket and different labels whose sketches pass.

    ``members``: key, doc, label, n, sketch, for buckets of several labels.  The
    label with most members is the crowd, the others the few.  Each block of the
    few meets each block of both, as a group of its own, so no group grows with
    the bucket.
    """
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    crowd = by_label.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all")).select("key", F.col("top.label").alias("crowd"), (F.col("all") - F.col("top.size")).alias("few"), F.col("top.size").alias("many"))
    m = members.join(crowd, "key")
    of = lambda n: F.greatest(F.ceil(n / F.lit(p.block)), F.lit(1)).cast("int")
    m = m.withColumn("rare", F.col("label") != F.col("crowd"))
    m = m.withColumn("own", F.pmod(F.xxhash64("doc", F.lit(3)), F.when(F.col("rare"), of(F.col("few"))).otherwise(of(F.col("many")))).cast("int"))
    # a cell: (block of the few, kind and block of the other side)
    all_few, all_many = F.sequence(F.lit(0), of(F.col("few")) - 1), F.sequence(F.lit(0), of(F.col("many")) - 1)
    cell = lambda i, kind, j, side: F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"), F.lit(side).alias("side"))
    own = F.col("own")
    as_few = F.concat(
        F.transform(all_many, lambda j: cell(own, "many", j, 0)),
        F.transform(all_few, lambda j: cell(own, "few", j, 0)),
        F.transform(all_few, lambda i: cell(i, "few", own, 1)),
    )
    as_many = F.transform(all_few, lambda i: cell(i, "many", own, 1))
    dealt = m.select("key", "doc", "label", "n", "sketch", F.explode(F.when(F.col("rare"), as_few).otherwise(as_many)).alias("c"))
    dealt = dealt.select("key", "c.i", "c.kind", "c.j", "c.side", "doc", "label", "n", "sketch").where("kind = 'many' or i <= j")
    most, num = p.most_ones, round(100 * p.threshold)
    cut = p.bits // 64

    def block(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        doc, label = t.column("doc").to_numpy(), t.column("label").to_numpy()
        sk = t.column("sketch").combine_chunks()
        sketch = np.asarray(sk.flatten()).view(U64).reshape(len(doc), (p.bits + p.parity_bits) // 64)
        size = t.column("n").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in left.tolist():
            r = right[label[right] != label[i]]
            x = np.bitwise_count(sketch[r] ^ sketch[i])
            near = (100 + num) * x[:, cut:].sum(axis=1, dtype=np.int64) <= (100 - num) * (size[r] + size[i])
            r = r[near & (x[:, :cut].sum(axis=1) <= most)]
            a.append(np.minimum(doc[r], doc[i]))
            b.append(np.maximum(doc[r], doc[i]))
        return pa.table({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

    return dealt.groupBy("key", "i", "kind", "j").applyInArrow(block, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included; ``kept`` marks rows that carry it.  Null or empty text has no
    shingles and no links.  Rows of one id count as one document, which links
    whatever any of them links to.  A null id is never linked and has a null
    component.  Other columns are not used.
    """
    p = params or Params()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialise(signatures(docs, p), "signatures")
    # written, so that its join to the rows is of two plain exchanges, where Spark splits a class of many rows
    classes = materialise(sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # several classes may share rows of one id: those are links too
    reps = sig.where("digest is not null").join(classes.select(F.col("rep").alias("doc_id"), F.col("digest")), ["doc_id", "digest"])
    reps = materialise(reps.dropDuplicates(["doc_id", "digest"]).select("doc_id", "bands", "sketch", F.col("n_shingles").alias("n")), "representatives")
    rows = materialise(sig.select("doc_id", "n_shingles", "digest"), "rows")
    discard(sig)
    some = rows.where("digest is not null and doc_id is not null")
    owner = some.select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("key", "leader")
    buckets = materialise(keyed.join(lead, "key").select("key", F.col("doc_id").alias("doc"), "leader"), "buckets")
    sketches = reps.select(F.col("doc_id").alias("doc"), "sketch", "n")
    met = buckets.where("doc <> leader").select("doc", "leader").distinct()
    met = met.join(sketches, "doc").join(reps.select(F.col("doc_id").alias("leader"), F.col("sketch").alias("theirs"), F.col("n").alias("m")), "leader")
    num = round(100 * p.threshold)
    apart = _ones("sketch", "theirs", p.bits // 64, p.parity_bits)
    met = met.withColumn("apart", apart).where(F.lit(100 + num) * F.col("apart") <= F.lit(100 - num) * (F.col("n") + F.col("m")))
    met = met.withColumn("ones", _ones("sketch", "theirs", 0, p.bits)).where(F.col("ones") <= p.most_ones)
    # a document has at most as many leaders as there are bands
    best = met.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list(F.struct("ones", "apart", "leader"))), 1, p.leaders).alias("m"))
    best = materialise(best.select("doc", F.explode("m.leader").alias("a")).select("a", F.col("doc").alias("b")), "best")

    wanted = buckets.select(F.col("doc").alias("doc_id")).distinct()
    sets = materialise(full_sets(docs.join(wanted, "doc_id", "left_semi"), p), "sets")
    first = materialise(confirm(best, sets, p), "links")
    labels = components(first)
    label = F.coalesce("component", "doc").alias("label")
    marked = buckets.join(labels.withColumnRenamed("vertex", "doc"), "doc", "left").select("key", "doc", label)
    split = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    members = marked.join(split, "key").join(sketches, "doc")
    second = confirm(_cross(members.select("key", "doc", "label", "n", "sketch"), p), sets, p)

    links = materialise(first.unionByName(second), "all-links")
    discard(buckets, best, sets, first)
    linked = components(links.unionByName(owner.join(some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")))
    discard(links, reps)
    out = rows.join(classes, "digest", "left").join(linked.withColumnRenamed("vertex", "rep"), "rep", "left")
    # a row whose id is linked under another class of the same id
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "rep", "doc_id"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
