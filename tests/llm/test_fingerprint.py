import hashlib

import xxhash
from pyspark.sql import functions as F
from siftloom.llm import fingerprint as M

TEXTS = [
    "One two three. Four five\nSix seven eight nine!\n\nTen", "", None, "a", "😀é漢 b\nc", "same text here. And more of it", "same text here. And more of it",
    "word " * 5000, "\n\n\n", "x. y. z.\nlast line of it", "|;,=:. odd . marks = in ; text",
]


def test_edits(spark):
    rows = [(5 * i, t, "p") for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in M.edits(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()}
    assert len(out) == len(rows)
    down = sorted(rows, reverse=True)
    for k, (i, t, _) in enumerate(down):
        t, nxt = t or "", down[(k + 1) % len(down)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    by_text = {}
    for i, t, _ in rows:
        assert by_text.setdefault(t or "", out[i].fingerprint) == out[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert out[25].near_next < 1 and out[30].near_next == 1.0


def test_rows_of_one_id_null_ids_and_none(spark):
    rows = [(1, "a"), (1, "a"), (1, "b c"), (None, "d"), (2, "e")]
    assert M.edits(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
    assert M.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert M.edits(spark.createDataFrame([(3, "only one")], "doc_id long, text string")).count() == 1


def test_branches_locate_edits(spark):
    text = "\n".join(f"line {i} with some words." for i in range(30))
    other = text.replace("line 17 with", "line 17 without")
    df = spark.createDataFrame([(text, other)], "a string, b string").select(M.fingerprint(F.col("a")).alias("x"), M.fingerprint(F.col("b")).alias("y"))
    r = df.select(M.differing_paragraphs(F.col("x"), F.col("y")).alias("d"), M.likeness(F.col("x"), F.col("y")).alias("l"), M.root(F.col("x")).alias("h")).first()
    assert r.d == [17] and 0.9 < r.l < 1 and len(r.h) == 64


def _tree(text):
    """Leaves, paragraphs, sections and root of a text, one word after the other."""
    cut = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves, sections, open_ = set(), [], []
    parts = text.split("\n")
    for last, p in [(i + 1 == len(parts), p) for i, p in enumerate(parts)]:
        phrases, start, words, at = [], None, 0, 0
        while at < len(p):
            if p[at] in " \t\x0b\f\r":
                at += 1
                continue
            end = at
            while end < len(p) and p[end] not in " \t\x0b\f\r":
                end += 1
            start = at if start is None else start
            words += 1
            stop = end
            at = end
            if words == 12 or p[end - 1] in ".!?":
                phrases.append(p[start:stop])
                start, words = None, 0
        if start is not None:
            phrases.append(p[start:stop])
        ids = [f"{xxhash.xxh64(x.encode(), seed=42).intdigest():x}".rjust(8, "0")[-8:] for x in phrases]
        leaves |= set(ids)
        open_.append((cut(p)[:16], ids))
        if cut(p)[-1] in "048c" or last:
            sections.append(open_)
            open_ = []
    heads = [cut(",".join(h for h, _ in x))[:16] for x in sections]
    body = ";".join(f"{h}:" + ",".join(f"{q}=" + ".".join(ids) for q, ids in x) for h, x in zip(heads, sections, strict=True))
    return cut(";".join(heads)) + ";" + body, leaves


def _alike(a, b):
    (x, m), (y, n) = _tree(a), _tree(b)
    return 1.0 if x[:64] == y[:64] else 2 * len(m & n) / (len(m) + len(n)) if m or n else 0.0


def test_query_equals_trees_built_word_by_word(spark):
    from siftloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    out = {r.doc_id: r for r in queries.op5_fingerprints(spark, sf).collect()}
    assert len(out) == len(docs)
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert (r.fingerprint, r.edited_fingerprint) == (_tree(t)[0], _tree(edited)[0])
        assert abs(r.near_edited - _alike(t, edited)) < 1e-12 and abs(r.near_next - _alike(t, nxt)) < 1e-12


def test_odd_texts_equal_trees_built_word_by_word(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.fp for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", M.fingerprint(F.col("text")).alias("fp")).collect()}
    assert got == {i: _tree(t or "")[0] for i, t in rows}


def test_many_rows_of_one_id(spark):
    df = spark.range(6000).select(F.when(F.col("id") >= 3000, 7).alias("doc_id"), F.concat(F.lit("text of row "), F.col("id") % 50).alias("text"))
    out = M.edits(df)
    assert out.count() == 6000 and out.where("doc_id is null").count() == 3000
