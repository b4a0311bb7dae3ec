import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftloom.llm import suffixlm as L


def corpus(n, seed):
    r = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "ba", "ko"]
    return [(i, " ".join(r.choice(["The", "of", "and"]) if r.random() < 0.4 else "".join(r.choice(syl) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120)))) for i in range(n)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Tree:
    """The model by dictionaries."""

    def __init__(self, rows, p):
        self.p = p
        learn = [L.tokens(t) for i, t in rows if not held(i)]
        self.c = Counter(w for ws in learn for w in ws)
        self.n = sum(self.c.values()) + len(learn)
        self.least = min(p.symbol_count, p.symbol_share * max(self.n, 1))
        e = Counter()
        for w, m in self.c.items():
            if m < self.least:
                e[w[-p.ending :]] += m
        self.big = {x for x, m in e.items() if m >= self.least}
        self.mass = Counter({"other": 1, "end": len(learn) + 1})
        for x in self.big:
            self.mass["e", x] += 1
        for w, m in self.c.items():
            s = self.symbol(w)
            self.mass[s] += m + 1 + (s[0] == "w")
        total = sum(self.mass.values())
        self.root = {s: m / total for s, m in self.mass.items()}
        self.levels = []
        seqs = [[*map(self.symbol, ws), "end"] for ws in learn]
        wanted = None
        for d in range(1, p.depth + 1):
            pairs = defaultdict(Counter)
            for s in seqs:
                for k, x in enumerate(s):
                    ctx = self.context(s, k, d)
                    if ctx is not None and (wanted is None or ctx in wanted):
                        pairs[ctx][x] += 1
            kept = {}
            for ctx, xs in pairs.items():
                t = sum(xs.values())
                up = {x: self.prob(ctx[1:], x) for x in xs}
                gain = sum(m * math.log((m - 1 + p.pull * up[x]) / ((t - 1 + p.pull) * up[x])) for x, m in xs.items())
                if gain >= p.divergence:
                    kept[ctx] = (t, xs)
            self.levels.append(kept)
            wanted = {(*ctx, x) for ctx, xs in pairs.items() for x, m in xs.items() if m >= p.context_count}

    def symbol(self, w):
        return ("w", w) if self.c[w] >= self.least else ("e", w[-self.p.ending :]) if w[-self.p.ending :] in self.big else "other"

    @staticmethod
    def context(s, k, d):
        return tuple(s[k - d : k]) if k >= d else ("start", *s[:k]) if k == d - 1 else None

    def prob(self, ctx, x):
        """Probability in the longest retained suffix of ``ctx``."""
        for d in range(len(ctx), 0, -1):
            if ctx[-d:] in self.levels[d - 1]:
                t, xs = self.levels[d - 1][ctx[-d:]]
                return (xs[x] + self.p.pull * self.prob(ctx[len(ctx) - d + 1 :], x)) / (t + self.p.pull)
        return self.root[x]

    def score(self, text):
        ws = L.tokens(text)
        s = [*map(self.symbol, ws), "end"]
        out = sum(math.log10((self.c[w] + 1) / self.mass[self.symbol(w)]) for w in ws)
        for k, x in enumerate(s):
            ctx = self.context(s, k, min(self.p.depth, k + 1))
            out += math.log10(self.prob(ctx, x))
        return out


def test_counts_match_and_the_tree_beats_the_base(spark, odd_texts):
    rows = corpus(300, 3) + [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "no id the"), (7, "same id"), (7, "same id")]
    df = spark.createDataFrame([(i, t, 1.0, 3) for i, t in rows], "doc_id long, text string, score double, block int").repartition(3)
    p = L.Params(block_bytes=4000, part_rows=2000)
    tree = Tree(rows, p)
    c, n = tree.c, tree.n
    v = len(c) + 2
    out = L.score_documents(df, p).collect()
    got = {r.doc_id: r for r in out if r.doc_id != 7}
    assert len(out) == len(rows) and sum(r.doc_id == 7 for r in out) == 3
    for i, t in rows:
        if i == 7:
            continue
        ws = L.tokens(t)
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v)) for w in ws) + math.log10((sum(not held(i) for i, _ in rows) + 1) / (n + v))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    test = [got[i] for i, _ in rows[:300] if i != 7 and held(i)]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


@pytest.mark.parametrize("p", [L.Params(block_bytes=20_000, symbol_count=30, symbol_share=0.5, part_rows=3000), L.Params(block_bytes=2_000, symbol_count=10, symbol_share=0.5, context_count=5, depth=4, ending=2), L.Params(depth=1)])
def test_scores_equal_those_of_a_tree_of_dictionaries(spark, p):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a c b d", "e c b f", "q", "z y"]) if r.random() < 0.9 else f"w{r.randint(0, 99)}x{r.randint(0, 9)}" for _ in range(40))) for i in range(200)]
    rows += [(1000, "one two three four five " * 3), (1001, "one two three four five " * 3), (1002, ""), (1003, None), (1004, "a")]
    tree = Tree(rows, p)
    got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert p.depth < 3 or len(tree.levels[2]) >= 2
    for i, t in rows:
        assert math.isclose(got[i], tree.score(t), rel_tol=1e-9), i


def test_distributions_sum_to_one():
    rows = [(i, f"{t} to be or not {t}") for i, t in corpus(60, 4)]
    tree = Tree(rows, L.Params(symbol_count=20))
    assert all(tree.levels)
    for ctx in [(), *list(tree.levels[0])[:5], *list(tree.levels[1])[:20], *list(tree.levels[2])[:20]]:
        assert math.isclose(sum(tree.prob(ctx, x) for x in tree.root), 1.0, rel_tol=1e-9)


def test_a_passage_that_occurs_twice_is_remembered(spark):
    """Least counts are absolute, so two occurrences count in a corpus of any size."""
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(60))
    ids = [i for i in range(700) if not held(i)]
    rows = [(i, text()) for i in ids]
    rows[11] = (ids[11], rows[10][1])
    got = {x.doc_id: (x.score - x.base_score) / x.n_tokens for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), L.Params(block_bytes=9000)).collect()}
    others = [v for i, v in got.items() if i not in (ids[10], ids[11])]
    assert min(got[ids[10]], got[ids[11]]) > max(others)


def test_empty_and_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.score_documents(df.limit(0)).count() == 0
    r = L.score_documents(df, hold=F.lit(True)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 and r.score < 0
    with pytest.raises(ValueError):
        L.Params(context_count=1)


def test_packed_arrays():
    a = np.array([0, 1, 255, 256, 1 << 40, (1 << 48) - 1], dtype=np.uint64)
    assert (L.unpack(L.pack(a, np.uint64, 6), np.uint64, 6) == a).all() and len(L.unpack(L.pack(a[:0], np.uint64), np.uint64)) == 0


def traced(f):
    """What ``f`` returns, and the bytes that its arrays took at once."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_is_walked_with_few_arrays_of_its_tokens():
    """Workers share an executor's memory: a block's walk took twice these bytes a token."""
    r, p, n = np.random.default_rng(3), L.Params(), 400_000
    names = np.sort(r.integers(10, 1 << 63, 5000).astype(np.uint64))
    ids = np.minimum(r.zipf(1.3, n) - 1, len(names) - 1).astype(np.uint32)
    ids[1::2] = (ids[::2] + 1) % len(names)  # so that contexts of one symbol are retained
    roots = np.log10((np.bincount(ids, minlength=len(names)) + 1) / (n + len(names)))
    row = {"block": 1, "ids": L.pack(ids, np.uint32), "names": L.pack(names, np.uint64), "roots": L.pack(roots, np.float64), "size": [1000] * (n // 1000), "held": [k % 7 == 2 for k in range(n // 1000)]}
    told = []
    for level in range(p.depth + 1):
        right = pa.Table.from_pylist(told, schema=L._arrow(L._ANSWER))
        (logp, rows), took = traced(lambda: L.walk(row, L.Answers(right, level), 4, p))  # noqa: B023
        assert took < 60 * n, (level, took / n)
        for k in range(4):
            asked = [L._row(x, L._arrow(L._ASKED)) for x in rows if x[1] == k]
            told += [x for b in L.judge(pa.Table.from_batches(asked), level, p) for x in b.to_pylist()]
    assert np.array_equal(L.walk(row, L.Answers(right, p.depth), 4, p, ask=False)[0], logp)
    assert (logp != roots[ids]).mean() > 0.4


def test_distinct_values_as_numpy_finds_them():
    r = np.random.default_rng(4)
    for a in (r.integers(0, 50, 300), r.integers(0, 1 << 63, 9).astype(np.uint64), np.zeros(0, np.int64), np.zeros(4, np.int64)):
        values, some, inv = L.distinct(a)
        want, back = np.unique(a, return_inverse=True)
        assert np.array_equal(values, want) and np.array_equal(inv, back) and np.array_equal(a[some], want)
