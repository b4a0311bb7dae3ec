"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An encoded span is an element of a monoid: its text with its token ids, the
empty span as identity, and :meth:`TreeBPE.join` as the operation.  A document
is encoded by encoding its halves and joining them.  A join keeps both sides'
tokens but for a window around the seam, which it encodes again.  The window
grows until each edge is a *cut*: a place where the split pattern starts a new
match whatever follows or precedes.  Two kinds are used:

* white space after anything that is not: no alternative of the pattern crosses
  it, and the pattern looks ahead only from inside a run of white space;
* punctuation other than an apostrophe after a letter or digit.

Tokens outside the cuts equal those of the whole text, so the join is exact.
An edge that meets no cut runs to the end of the span, which needs none.
Decoding concatenates the byte strings of tokens up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .words import slices

#: Longest span that is encoded without halving.
LEAF_CHARS = 1024
#: Leaves remember the tokens of words; the memo is emptied at so many.
MEMO = 200_000

_CUT = re.compile(r"(?<=\S)\s|(?<=[A-Za-z0-9])[!-&(-/:-@\[-`{-~]")
_BLANKS = re.compile(r"\s ")
#: Words that the pattern takes as one match, with the space before them.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The alternative of the pattern that makes it so; for other patterns every word goes the long way.
_LETTER_RUN = r"| ?\p{L}+|"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base-64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Memo(dict):
    """Words after a single space to the little-endian ids of space and word."""

    def __init__(self, encode, piece):
        super().__init__()
        self.encode, self.piece = encode, piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self.piece((" " + word).encode()) if _LETTERS.fullmatch(word) else self.encode(" " + word)
        got = self[word] = pack("<%dI" % len(ids), *ids)
        return got


class TreeBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        ranks = load_ranks(ranks_path)
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = enc.encode_ordinary
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.length = np.array([len(x) for x in self.table], dtype=np.int64)
        self.memo = _Memo(self.raw, enc._core_bpe.encode_single_piece if _LETTER_RUN in pattern else self.raw_bytes)
        self.leaf_chars = max(leaf_chars, 1)

    def raw_bytes(self, word: bytes) -> list[int]:
        return self.raw(word.decode())

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.raw(text), dtype="<u4")

    def _leaf(self, text: str) -> np.ndarray:
        """Tokens of a short span; a space after a word is a cut, so words are independent."""
        if _BLANKS.search(text) or text[:1] == " ":
            return self._direct(text)
        first, *rest = text.split(" ")
        # a trailing space stands alone: it is the word "" after a space
        return np.frombuffer(self._direct(first).tobytes() + b"".join([self.memo[w] for w in rest]), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """Token ids (unsigned 32-bit) of a whole text."""
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Tokens of ``left + right`` from those of both."""
        if not left or not right:
            return b if not left else a
        span = 16
        while True:  # the last cut of the left side
            at = max(len(left) - span, 0)
            cuts = [m.start() for m in _CUT.finditer(left, max(at - 1, 0)) if m.start() > at]
            if cuts or at == 0:
                lo = cuts[-1] if cuts else 0
                break
            span *= 2
        span = 16
        while True:  # the first cut of the right side; the seam itself is judged with the text before it
            to = min(span, len(right))
            near = right[: to + 1]
            m = _CUT.search(near, 1)
            if m or to == len(right):
                hi = m.start() if m else len(right)
                break
            span *= 2
        window = left[lo:] + right[:hi]
        drop_a = self._covering(a[::-1], len(left[lo:].encode()))
        drop_b = self._covering(b, len(right[:hi].encode()))
        return np.concatenate([a[: len(a) - drop_a], self._direct(window), b[drop_b:]])

    def _covering(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens make up the first ``n_bytes`` bytes."""
        if not n_bytes:
            return 0
        k = 64
        while True:
            sums = np.cumsum(self.length[ids[:k]])
            if sums[-1] >= n_bytes:
                return int(np.searchsorted(sums, n_bytes)) + 1
            k *= 4

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence."""
        if len(ids) <= 4 * self.leaf_chars:
            return b"".join(map(self.table.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple, TreeBPE] = {}


def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeBPE:
    """One codec per worker process, vocabulary and length of leaves."""
    key = (ranks_path, pattern, leaf_chars)
    if key not in _CODECS:
        _CODECS[key] = TreeBPE(ranks_path, pattern, leaf_chars)
    return _CODECS[key]


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the token ids of each text and the bytes that they decode to.

    ``ids_col``: binary, little-endian unsigned 32-bit integers; ``decoded_col``:
    binary.  Null text counts as empty and gives two empty values.  All other
    columns pass through, and columns of the two names are replaced.  Rows are
    independent: no shuffle; repeated rows stay as they are.
    """
    small_batches(df.sparkSession)
    df = df.drop(*[c for c in (ids_col, decoded_col) if c in df.columns])
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for b in slices(batches, text_col):
            ids, back = [], []
            for x in b.column(b.schema.get_field_index(text_col)).to_pylist():
                got = bpe.encode(x or "")
                ids.append(got.tobytes())
                back.append(bpe.decode(got))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[*b.schema.names, ids_col, decoded_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Per document: number of tokens and SHA-256 of ids and decoded bytes."""
    return df.select(
        "doc_id",
        F.expr(f"cast(octet_length(`{ids_col}`) div 4 as bigint)").alias("n_tokens"),
        F.sha2(ids_col, 256).alias("ids_sha256"),
        F.sha2(decoded_col, 256).alias("decoded_sha256"),
    )
