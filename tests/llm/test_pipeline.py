import bisect
import collections
import math
import random
import re
import struct
import zlib

import public_tokenizers as P
import pyarrow as pa
from siftloom.llm import decontam, dedup, langid, quality, stages
from siftloom.llm.bpe import codec
from test_dedup import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items string"


def test_stages_keep_the_right_rows(spark):
    r = random.Random(4)
    vocab = [f"word{chr(97 + i)}" for i in range(26)] + ["the", "of"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(30, 90))) for _ in range(60)]
    bench = " ".join(r.choice(vocab) for _ in range(20))
    texts[5] += " " + bench
    texts += [texts[7], texts[7] + " tail", texts[8].replace(" ", "  "), None, "", "!!! 12"]
    docs = spark.createDataFrame([(i, t, "en", "s0", None, "x") for i, t in enumerate(texts)] + [(7, texts[7], "en", "s0", 1, "y"), (None, texts[9], "en", None, 1, "z")], DOCS)
    one = stages.language_id(docs)
    assert one.columns == docs.columns and {x.doc_id for x in one.collect()} == {*range(63), None}
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    two = stages.quality_filter(one, labels, )
    assert two.columns == docs.columns and two.count() == one.count()
    three = stages.one_of_each_group(two)
    assert three.columns == docs.columns
    ids = [x.doc_id for x in three.collect()]
    assert sorted(ids, key=str) == sorted([*range(60), None], key=str)
    items = spark.createDataFrame([(1, bench)], "item_id long, text string")
    four = stages.decontaminate(three, items)
    assert four.columns == docs.columns and {x.doc_id for x in four.collect()} == {*range(60), None} - {5}
    path = P.path("byte_bpe_multi_50k.tiktoken")
    five = stages.encode(four, path, P.PATTERN).collect()
    raw = codec(path, P.PATTERN).raw
    assert all(x.round_trip and x.n_tokens == len(raw(x.text or "")) for x in five)
    assert not set(dir(quality)) & {"lang"} and dedup.Params().shingle == 5 and decontam.BLOCK_WORDS > 0


def test_run_on_the_smallest_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.select("doc_id", "round_trip").collect()
    assert 50 < len(rows) < docs.count() and all(r.round_trip for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def plain_language(rows, p):
    """Ids of the rows that stay, from dictionaries: trigrams, the source's prior, fit."""
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    slot = lambda a, b, c: ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF) >> 16
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC3
    grams = {r["doc_id"]: [(slot(*g), all(letter(c) or c >= 0x80 for c in g)) for g in zip(t, t[1:], t[2:], strict=False)] for r in rows for t in [low(r["text"])]}
    counts = {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 2:
            counts.setdefault(r["lang"], collections.Counter()).update(s for s, _ in grams[r["doc_id"]])
    size = 1 << 16
    total = {x: sum(c.values()) + p.smoothing * size for x, c in counts.items()}
    logp = lambda x, s: math.log((counts[x][s] + p.smoothing) / total[x])
    langs, logs, q, fits = sorted(counts), {}, {}, {}

    def normal(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    for r in rows:
        i = r["doc_id"]
        logs[i] = [p.temper * sum(logp(x, s) for s, _ in grams[i]) for x in langs]
        q[i] = normal(logs[i])
        own = [s for s, inner in grams[i] if inner]
        fits[i] = max(sum(logp(x, s) for s in own) for x in langs) >= -(math.log(size) + 1e-3) * len(own)
    clear = [r for r in rows if any(map(letter, low(r["text"])))]
    mix = lambda c, prior, pull: [(a + pull * b) / (sum(c) + pull) for a, b in zip(c, prior, strict=True)]
    total_q = lambda some: [sum(q[r["doc_id"]][k] for r in some) for k in range(len(langs))]
    base = mix(total_q(clear), [1 / len(langs)] * len(langs), 1.0)
    kept = set()
    for r in clear:
        i = r["doc_id"]
        prior = base if r["source"] is None else mix(total_q([x for x in clear if x["source"] == r["source"]]), base, p.host_pull)
        if fits[i] and max(normal([a + math.log(b) for a, b in zip(logs[i], prior, strict=True)])) >= p.least:
            kept.add(i)
    return kept


def plain_quality(rows, m):
    """Ids of the rows whose tables add up to a score of at least 0.7."""
    kept = set()
    for r in rows:
        x = quality.features(pa.array([r["text"]], pa.string()))[0].tolist()
        z = m.intercept + sum(t[bisect.bisect_right(c.tolist(), v)] for t, c, v in zip(m.tables, m.cuts, x, strict=True))
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            z += t[bisect.bisect_right(m.pair_cuts[i].tolist(), x[i])][bisect.bisect_right(m.pair_cuts[j].tolist(), x[j])]
        if 1 / (1 + math.exp(-max(-30, min(30, z)))) >= 0.7:
            kept.add(r["doc_id"])
    return kept


def plain_contaminated(rows, items, n=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(w[k : k + n]) for t in items for w in [words(t)] if w for k in range(max(len(w) - n + 1, 1))}
    found = set()
    for r in rows:
        w, hit = words(r["text"]), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if hit and 20 * len(hit) >= len(w):
            found.add(r["doc_id"])
    return found


def test_whole_run_equals_a_plain_version(spark, tmp_path):
    """Every stage of run(), over the smallest tables with planted cases, row by row."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    real = sorted((r.asDict() for r in base.collect()), key=lambda r: r["doc_id"])
    good = [r["text"] for r in real if r["text"] and 400 < len(r["text"]) < 2500]
    swap = lambda t, k: " ".join("changed" if j == k else w for j, w in enumerate(t.split(" ")))
    planted = [None, "", "12 34 !!", "це зовсім інша мова " * 20, "$$$ || " * 90, good[0], good[0].upper(), swap(good[1], 40), good[2] + " " + items[0], items[1], good[3], None]
    rows = real + [{**real[0], "doc_id": 10_000 + i, "text": t, "lang": None, "source": [None, "s0"][i % 2]} for i, t in enumerate(planted)]
    spark.createDataFrame(rows, base.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    ids = plain_language(rows, langid.Params())
    assert {r["doc_id"] for r in rows} - ids >= {10_000, 10_001, 10_002, 10_003, 10_011}
    one = [r for r in rows if r["doc_id"] in ids]
    m = quality.train(spark.createDataFrame(one, base.schema), spark.read.parquet(f"{sf}/labels.parquet"))
    ids = plain_quality(one, m)
    two = [r for r in one if r["doc_id"] in ids]
    assert len(two) < len(one)
    ids = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in two], 5) if kept}
    three = [r for r in two if r["doc_id"] in ids]
    assert len(three) < len(two)
    ids = plain_contaminated(three, items)
    four = {r["doc_id"]: r for r in three if r["doc_id"] not in ids}
    assert len(four) < len(three)

    raw = codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).raw
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(four)
    for r in out:
        ids = raw(r.text)
        assert r.asDict() == {**four[r.doc_id], "token_ids": bytearray(struct.pack(f"<{len(ids)}I", *ids)), "n_tokens": len(ids), "round_trip": True}
