import hashlib
import random
import re

from siftloom.llm import decontam


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(docs, items, n=13):
    out = {}
    for i, t in docs:
        w = words(t)
        hit, got = set(), set()
        for item, text in items:
            v = words(text)
            wins = [v[k : k + n] for k in range(max(len(v) - n + 1, 1))] if v else []
            for win in wins:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        got.add(item)
        got = sorted(str(x) for x in got if x is not None)
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def case(seed):
    r = random.Random(seed)
    vocab = ["ab", "Cd", "é", "x1", "foo", "BAR", "zz"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(12)] + [(90, None), (None, "foo foo foo foo"), (91, "Only, Here!"), (91, "ab ab ab")]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 90))]
        if r.random() < 0.7:
            at, v = r.randint(0, len(w)), r.choice(items)[1] or ""
            w[at:at] = v.split()[: r.choice([5, 13, 99])]
        docs.append((i, r.choice([" ", "  ", ", "]).join(w)))
    return docs + [(100, None), (101, ""), (102, "only\nhere"), (103, "zz " * 3000 + "only here")], items


def test_hits_match_brute_force(spark, monkeypatch):
    docs, items = case(4)
    d = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (decontam.BLOCK_WORDS, 10):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        out = decontam.verdicts(decontam.find_windows(d, b)).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out}
        assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.verdicts(decontam.find_windows(d, b)).first().n_hit == 0
    assert decontam.find_windows(d.limit(0), b).count() == 0
