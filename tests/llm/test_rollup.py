from collections import Counter

import public_tokenizers as P
from siftloom.llm import rollup
from siftloom.llm.store import scratch

ROWS = "source string, lang string, version string, n long"


def test_deltas_are_idempotent_and_add_up(spark):
    store = rollup.Rollup(spark, scratch(spark, "test-rollup"))
    assert store.totals().count() == 0
    a = [("s", "en", "1", 5), ("s", "en", "1", 7), ("t", None, "1", 3), (None, "de", "2", 4), ("s", "de", "1", None)]
    assert store.commit("a", rollup.inserts(spark.createDataFrame(a, ROWS)))
    assert not store.commit("a", rollup.inserts(spark.createDataFrame(a, ROWS)))
    assert store.commit("b", rollup.deletes(spark.createDataFrame([("s", "en", "1", 7), (None, "de", "2", 4)], ROWS)))
    rev = spark.createDataFrame([("t", None, "1", 3, 10)], "source string, lang string, version string, n_old long, n_new long")
    assert store.commit("c", rollup.revisions(rev))
    assert store.commit("none", rollup.revisions(rev.limit(0)))

    def check():
        got = {(r.level, r.source, r.lang, r.version): (r.tokens, r.documents) for r in store.totals().collect()}
        assert got == {
            ("source,lang,version", "s", "en", "1"): (5, 1), ("source,lang,version", "t", None, "1"): (10, 1), ("source,lang,version", "s", "de", "1"): (0, 1),
            ("source,version", "s", None, "1"): (5, 2), ("source,version", "t", None, "1"): (10, 1),
            ("lang,version", None, "en", "1"): (5, 1), ("lang,version", None, None, "1"): (10, 1), ("lang,version", None, "de", "1"): (0, 1),
            ("version", None, None, "1"): (15, 3),
        }

    check()
    store.compact()
    assert len(store.committed()) == 1
    check()
    assert not store.commit("b", rollup.deletes(spark.createDataFrame(a, ROWS)))
    check()


def test_counts(spark, odd_texts):
    from siftloom.llm.bpe import codec
    from siftloom.llm.tokenbin import encoder

    v = {"b": ("ranks", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "a": ("word", P.path("word_bpe_49k.json"))}
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(odd_texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in rollup.count_tokens(docs, v).collect()}
    w, c = encoder(P.path("word_bpe_49k.json"), 2), codec(*v["b"][1:])
    assert got == {i: [len(w.encode(t or "")) // 2, len(c.raw(t or ""))] for i, t in enumerate(odd_texts)}
    assert Counter(map(len, got.values())) == {2: len(odd_texts)}


def test_totals_of_the_query_equal_a_plain_recount(spark):
    """One row of each text, its own counts under both tokenizers, whatever the batches did to get there."""
    from collections import Counter

    import public_tokenizers
    import pyarrow.parquet as pq
    import tokenizers
    from siftloom.llm import queries
    from siftloom.llm.bpe import codec

    rows = sorted(pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    ranks = codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    word = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seen, want, docs = set(), Counter(), Counter()
    for r in rows:
        if r["text"] is not None and r["text"] in seen:
            continue
        seen.add(r["text"])
        t = r["text"] or ""
        for version, n in (("byte-bpe-multi-1", len(ranks.encode(t))), ("word-bpe-1", len(word.encode(t, add_special_tokens=False).ids))):
            want[r["source"], r["lang"], version] += n
            docs[r["source"], r["lang"], version] += 1
    got = {(r.source, r.lang, r.version): (r.tokens, r.documents) for r in queries.op10_token_rollup(spark, "/root/testdata/sf0.001").collect() if r.level == "source,lang,version"}
    assert got == {k: (n, docs[k]) for k, n in want.items()}
