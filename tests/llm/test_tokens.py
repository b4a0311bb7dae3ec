import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import types as T
from siftloom.llm import bpe, store, tokenbin

DOCS = "doc_id long, text string, extra int, n_tokens int"


def test_tree_equals_whole_encoding():
    b = bpe.TreeBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, leaf_chars=4)
    r = random.Random(2)
    for _ in range(3000):
        s = "".join(r.choice("ab cd'sét  \n\t.,!$12 'll漢字　\x1c😀") for _ in range(r.randint(0, 70)))
        assert b.encode(s).tolist() == b.raw(s)
        assert b.decode(b.encode(s)) == s.encode()


def test_encode_decode(spark, odd_texts):
    import tiktoken

    rows = [(i, t, 1, 2) for i, t in enumerate(odd_texts)] + [(None, "a b", None, None)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(spark.createDataFrame(rows, DOCS), path, P.PATTERN)).collect()}
    ref = tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for i, t, *_ in rows:
        ids = np.array(ref.encode_ordinary(t or ""), dtype="<u4")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(bpe.encode_decode(spark.createDataFrame([], DOCS), path, P.PATTERN)).count() == 0


def test_token_files(spark, odd_texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [(3 * i, t, 1, 2) for i, t in enumerate(odd_texts)] + [(None, "null id", 0, 0), (9, "same id", 0, 0)]
    manifest = tokenbin.write_tokens(spark.createDataFrame(rows, DOCS).repartition(3), path, 2)
    got = sorted(tokenbin.crc_digest(tokenbin.read_tokens(manifest)).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(path)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    start, want = 0, {}
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    empty = tokenbin.write_tokens(spark.createDataFrame([], DOCS), path, 2)
    assert tokenbin.read_tokens(empty).count() == 0
    assert isinstance(manifest.schema["base"].dataType, T.LongType)


def test_ranges_follow_the_stored_bytes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(300)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    stored, usual = spark.read.parquet(f"{tmp_path}/d"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert store.ranges(docs) == store.ranges(stored) == usual
    want = sorted(tokenbin.crc_digest(tokenbin.read_tokens(tokenbin.write_tokens(stored, P.path("word_bpe_49k.json"), 2))).collect())
    monkeypatch.setattr(store, "RANGE_BYTES", 1000)
    assert store.ranges(stored) > 2 * usual and store.ranges(stored.join(docs, "doc_id")) == store.ranges(stored)
    many = tokenbin.write_tokens(stored, P.path("word_bpe_49k.json"), 2)
    assert many.count() > usual and sorted(tokenbin.crc_digest(tokenbin.read_tokens(many)).collect()) == want


def test_tokens_are_digested_where_they_are_read(spark, tmp_path):
    """One Python worker a task reads and digests; empty documents without an end id too."""
    from siftloom.llm import queries

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a b", None, "déjà vu", "x " * 5000])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_token_files(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    path = P.path("word_bpe_49k.json")
    for end in (2, None):
        manifest = tokenbin.write_tokens(docs, path, end)
        got, want = (sorted(x.collect()) for x in (tokenbin.read_crc(manifest), tokenbin.crc_digest(tokenbin.read_tokens(manifest))))
        assert got == want and len(got) == 5
        if end:
            assert sorted(out.collect()) == want
        else:
            assert (got[0].n_tokens, got[0].ids_crc32) == (0, 0)


CHARS = "abzK éÉßẞøØ×÷ÿŸ,.;$$'s't'll019 \t\n\r\x0b\x0c\x1c\x85\xa0́İıΣςK漢😀<|>_~«"


def test_encoder_equals_the_library_while_its_memos_turn_over(odd_texts, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, r = Tokenizer.from_file(path), random.Random(4)
    plain = [c for c in CHARS if c.isascii() and c not in "'<|\x1c"]
    texts = [*filter(None, odd_texts), *("".join(r.choice(k) for _ in range(r.randint(0, 40))) for k in (CHARS, plain, "abß,. 1", "abéÉ Aẞ") for _ in range(1500))]
    for memo, longest in ((250_000, 128), (5, 3)):
        monkeypatch.setattr(tokenbin, "MEMO", memo)
        monkeypatch.setattr(tokenbin, "MEMO_LENGTH", longest)
        enc = tokenbin.WordEncoder(path, 2)
        for t in texts:
            assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes(), t
        assert all(len(m) <= memo and len(m.older) <= memo for m in (enc.pieces, enc.words))
        assert all(len(k) <= longest for m in (enc.pieces, enc.words) for k in (*m, *m.older))


def test_a_piece_costs_the_model_once(monkeypatch):
    """Whatever marks, or words with odd characters, it stands beside, and for as long as it is asked for."""

    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, piece):
            self.asked.append(piece)
            return self.model.tokenize(piece)

    def asked(*texts):
        enc = tokenbin.WordEncoder(P.path("word_bpe_49k.json"), 2)
        enc.model = Counted(enc.model)
        for t in texts:
            enc.encode(t)
        return enc.model.asked

    assert asked("Sinfonietta, (sinfonietta) sinfonietta.", "sinfonietta;\n$$$sinfonietta4", "l'été sinfonietta! sinfonietta?").count("sinfonietta") == 1
    assert asked("straße, straße.", "Straße").count("straÃŁe") == 1
    monkeypatch.setattr(tokenbin, "MEMO", 4)
    many = asked(*(f"sinfonietta word{chr(97 + i) * 3}" for i in range(20)))
    assert many.count("sinfonietta") == 1 and len(many) == 21
