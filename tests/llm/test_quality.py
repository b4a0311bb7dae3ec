import random

import numpy as np
import pyarrow as pa
from siftloom.llm import quality


def corpus(n, seed):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "the", "of", "gamma", "delta", "and"] + [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        w = [r.choice(vocab) for _ in range(r.randint(20, 200))]
        if not good:
            w = [x + "$$$" if r.random() < 0.5 else x for x in w]
        rows.append((i, " ".join(w), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600, 1) + [(1000, None, 1), (1001, "", 0), (1002, "word " * 60000, 1)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, features string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1), (77777, 0)], "doc_id long, quality int")
    p = quality.Params(rounds=30, pair_rounds=5, pairs=3)
    out = {r.doc_id: r for r in quality.classify(docs, labels, p).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    import zlib

    held = [(out[i], q) for i, _, q in rows[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in out.values()) >= len(held)
    assert np.mean([(r.score >= 0.5) == bool(q) for r, q in held]) > 0.95
    kept = {r.doc_id for r in quality.keep_good(docs, labels, p).collect()}
    assert kept == {i for i, r in out.items() if r.score >= 0.7}


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    import zlib

    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows]
    p = quality.Params(rounds=5, pair_rounds=2, pairs=2)
    a = quality.classify(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"), p).collect()
    b = quality.classify(docs, spark.createDataFrame(flip, "doc_id long, quality int"), p).collect()
    assert sorted(a) == sorted(b)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, none).count() == 2
    assert quality.classify(docs.limit(0), none).count() == 0
    assert np.isfinite(quality.features(pa.array([None, "", " ", "\n", "a" * 3000, "é|$ 5"]))).all()


def test_query_adds_up_the_tables_row_by_row(spark):
    import bisect
    import math
    import zlib

    from siftloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    out = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows) and any(r.held_out for r in out.values()) and len(m.pairs) == 8
    for r in rows:
        x = quality.features(pa.array([r.text]))[0].tolist()
        z = m.intercept + sum(t[bisect.bisect_right(c.tolist(), v)] for t, c, v in zip(m.tables, m.cuts, x, strict=True))
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            z += t[bisect.bisect_right(m.pair_cuts[i].tolist(), x[i])][bisect.bisect_right(m.pair_cuts[j].tolist(), x[j])]
        got = out[r.doc_id]
        assert abs(got.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert got.predicted == int(got.score >= 0.7) and got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
