"""Flat token files with 64-bit document offsets.

A corpus of token files is a folder of shards.  Shard ``s`` holds

* ``s.bin``  the token ids, unsigned little-endian integers of ``width`` bytes;
* ``s.off``  int64 offsets, one more than documents, in tokens from the shard's start;
* ``s.doc``  int64 document ids (``-2**63`` stands for null).

Documents ascend by id over the shards.  A shard's first global position is its
*base*: the prefix sum of the token counts of the shards before it, kept in the
manifest ``shards`` (Parquet, one row per shard).  Readers map the files.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import filesystem, local_path, ranges, scratch, small_batches, write_atomic
from .words import slices

NULL_ID = -(1 << 63)
#: Pieces, and as many words, that each worker remembers with their ids: the latest so many at least, twice as many at most.
MEMO = 250_000
#: Longest piece or word that is remembered.
MEMO_LENGTH = 128

#: Word pieces that normalise to themselves: ASCII and Latin-1 letters, and ASCII punctuation without the apostrophe.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Neither in a plain piece nor white space.
_ODD = re.compile(r"[^a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~ \t-\r]")


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level models write bytes as: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Values of ``make`` by key.  At ``MEMO`` keys all become the older half, which forgets those not asked for since."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > MEMO_LENGTH:
                return got
        if len(self) >= MEMO:
            self.older = self.copy()
            self.clear()
        self[key] = got
        return got


class WordEncoder:
    """Ids of whole texts from remembered tables of their pieces or words.

    For tokenizers that drop white space before their merges, the ids of a text
    are those of its white-space-separated words in a row.  Words of plain
    pieces go to the model piece by piece, others through the whole tokenizer.
    A text without odd characters is cut into pieces at once, so the model sees
    a piece once whatever marks it stands beside.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model
        self.code = {1: "B", 2: "H", 4: "I"}[width]
        self.chars = _byte_chars()
        self.pieces, self.words = _Memo(self._piece), _Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, low: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PLAIN.findall(low)))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        return self._plain(low) if len(low) == len(text) and not _ODD.search(low) else self._whole(text)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``text``."""
        if "<|" in text:  # special tokens are found in the text as it is
            return self._whole(text)
        low = text.lower()
        if len(low) == len(text) and not _ODD.search(low):
            return self._plain(low)
        return b"".join(map(self.words.__getitem__, text.encode().lower().split()))


@lru_cache(4)
def encoder(path: str, width: int) -> WordEncoder:
    return WordEncoder(path, width)


@lru_cache(4)
def id_width(path: str) -> int:
    """Bytes of the smallest unsigned integer that holds every id of a vocabulary."""
    from tokenizers import Tokenizer

    n = Tokenizer.from_file(path).get_vocab_size()
    return 2 if n <= 1 << 16 else 4


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None, out: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write token files; returns the manifest.

    One shuffle moves whole texts into ranges of ``doc_id`` (rows of equal id lie
    together, in text order; null ids come first).  Every task writes the files
    of its range under a name of its own attempt and moves them into place, so a
    task that runs again after the loss of an executor replaces equal files.
    Null text counts as empty and gives the end id alone.  An empty table gives
    an empty manifest.  Columns other than the two are not used.

    Manifest: shard, bin, off, doc (URIs), n_docs, n_tokens, base, width.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = out or scratch(spark, "tokens")
    width = id_width(tokenizer_path)
    dealt = docs.select("doc_id", "text").repartitionByRange(ranges(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = "shard long, bin string, off string, doc string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer_path, width), b"" if end_id is None else int(end_id).to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        base = f"{out}/{shard:07d}"
        docs_, ends = array("q"), array("q", [0])

        def chunks():
            at = 0
            for b in slices(batches, max_bytes=4 << 20):
                ids = b.column(0).fill_null(NULL_ID).to_pylist()
                part = []
                for i, x in zip(ids, b.column(1).to_pylist(), strict=True):
                    got = enc.encode(x or "") + end
                    at += len(got) // width
                    docs_.append(i)
                    ends.append(at)
                    part.append(got)
                yield b"".join(part)

        write_atomic(base + ".bin", chunks())
        if not docs_:
            return
        write_atomic(base + ".off", [ends.tobytes()])
        write_atomic(base + ".doc", [docs_.tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "bin": [base + ".bin"], "off": [base + ".off"], "doc": [base + ".doc"], "n_docs": [len(docs_)], "n_tokens": [ends[-1]]})

    # one row per shard comes to the driver: bounded by the number of partitions, whatever the data
    rows = sorted(dealt.mapInArrow(run, schema).collect())
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows], dtype=np.int64)]).tolist()
    full = [(*r, bases[i], width) for i, r in enumerate(rows)]
    manifest = spark.createDataFrame(full, schema + ", base long, width int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/shards")
    return spark.read.schema(manifest.schema).parquet(f"{out}/shards")


def open_map(uri: str, dtype) -> np.ndarray:
    """A flat file as an array: mapped where it is local, else read."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    f, p = filesystem(uri)
    with f.open_input_file(p) as src:
        return np.frombuffer(src.read_buffer(), dtype=dtype)


def read_tokens(manifest: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: str | None = None) -> DataFrame:
    """Documents of token files: doc_id, start (global), n_tokens, tokens (binary as in the file), width.

    ``then`` turns batches of these into others, of ``then_schema``, in the worker
    that reads them: tokens that are only digested never pass through the JVM to
    a second worker.
    """
    n = max(manifest.count(), 1)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("width", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in batches:
            for r in shards.to_pylist():
                ids = open_map(r["bin"], f"<u{r['width']}")
                off, doc = open_map(r["off"], "<i8"), open_map(r["doc"], "<i8")
                at = 0
                while at < len(doc):  # runs of about 4 MB
                    to = min(max(int(np.searchsorted(off, off[at] + (4 << 20) // r["width"], side="right")) - 1, at + 1), len(doc))
                    b = pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[at:to], mask=np.asarray(doc[at:to]) == NULL_ID),
                            pa.array(off[at:to] + r["base"]),
                            pa.array(np.diff(off[at : to + 1])),
                            pa.array([ids[off[i] : off[i + 1]].tobytes() for i in range(at, to)], pa.binary()),
                            pa.array(np.full(to - at, r["width"], dtype=np.int32)),
                        ],
                        names=schema.names,
                    )
                    yield then(b) if then else b
                    at = to

    return manifest.repartition(n, "shard").mapInArrow(run, then_schema or schema)


_CRC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _crc(b: pa.RecordBatch) -> pa.RecordBatch:
    crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype=f"<u{w}").astype("<u4")) for x, w in zip(b.column(3), b.column(4).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def crc_digest(tokens: DataFrame) -> DataFrame:
    """Per document: start, n_tokens and the CRC-32 of its ids as unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens", "width").mapInArrow(lambda batches: map(_crc, batches), _CRC)


def read_crc(manifest: DataFrame) -> DataFrame:
    """:func:`crc_digest` of :func:`read_tokens`, digested by the workers that read."""
    return read_tokens(manifest, _crc, _CRC)
