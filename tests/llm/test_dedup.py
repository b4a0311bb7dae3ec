import random
import re

from siftloom.llm import dedup
from siftloom.llm.components import components

DOCS = "doc_id long, text string, set string, label int"


def brute(rows, k, num=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is None or j is None or not s or not t:
                continue
            both = len(s & t)
            if 100 * both >= num * (len(s) + len(t) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, s in sets), key=str)


def corpus(seed, n=140):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 30, 120, 300]))] for _ in range(25)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            if len(w) > 3:
                w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w) if r.random() < 0.8 else " \n".join(w).upper())
    return out


def test_near_duplicates_match_brute_force(spark, odd_texts):
    texts = corpus(3) + odd_texts[:16] + ["", None]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    for block in (2048, 4):
        got = dedup.near_duplicates(df, dedup.Params(shingle=4, block=block)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4)


def test_empty(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f", "", 0), (7, "a b c d e f", "", 0), (9, "a b c d e f", "", 0)], DOCS)
    assert [r.component_id for r in dedup.near_duplicates(df).collect()] == [7, 7, 7]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (3, 2)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
