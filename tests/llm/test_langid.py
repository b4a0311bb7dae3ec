import collections
import functools
import math
import random
import zlib

from siftloom.llm import langid

VOC = {"en": "the and of with this that have from".split(), "de": "der die und nicht für über ein straße".split(), "fr": "le la et être où ça dans une".split()}


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(VOC))
        out.append((i, " ".join(r.choice(VOC[lang]) for _ in range(r.randint(5, 60))), lang, f"s{r.randint(0, 3)}", 1))
    return out


def test_held_out_accuracy_and_rejection(spark):
    data = rows(400, 1) + [(900, None, "en", "s1", 1), (901, "", "en", None, 1), (902, "12 34 !!", None, "s2", 1), (903, "the and " * 40000, "en", "s0", 1), (None, "die und nicht", "de", "s0", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, confidence int")
    langs, table = langid.train_text(docs)
    assert langs == ["de", "en", "fr"]
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", F.col("source").alias("host"), langid.held_out().alias("h")), ["doc_id", "h"], langs, table).collect()}
    assert len(out) == len(data)
    test = [(out[i], lang) for i, _, lang, *_ in data[:400] if out[i].h]
    assert len(test) > 40 and sum(r.language == lang for r, lang in test) > 0.97 * len(test)
    assert not any(out[i].accepted for i in (900, 901, 902)) and out[903].language == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in data} - {900, 901, 902}


def test_markup_address_and_host_settle_short_texts(spark):
    docs = spark.createDataFrame(rows(300, 2), "doc_id long, text string, lang string, source string, n int")
    langs, table = langid.train_text(docs)
    pages = [(i, f"http://{lang}.site.org/{lang}/{i}", f'<html lang="{lang}-XX"><script>x</script><p>{t}</p></html>') for i, t, lang, *_ in rows(200, 3)]
    pages += [(1000, "http://de.site.org/de/1", '<html lang="de">in</html>'), (1001, None, None), (1002, "http://fr.site.org/x", "<p>a</p>")]
    df = langid.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    out = {r.page_id: r for r in langid.identify(df, ["page_id"], langs, table).collect()}
    assert out[1000].language == "de" and out[1000].confidence > 0.9
    assert out[1002].language == "fr" and not out[1001].accepted


def test_texts_that_no_language_fits_are_rejected_and_rare_languages_are_known(spark):
    data = rows(300, 6) + [(500, "це зовсім інша мова " * 20, "en", "s0", 1), (501, "δεν είναι " * 9, None, "s1", 1), (502, "zzq " * 50, None, "s0", 1)]
    data += [(600 + i, "och det är inte för en som " * 4, "sv", "s9", 1) for i in range(3)]
    docs = spark.createDataFrame([x for x in data if x[0] != 500], "doc_id long, text string, lang string, source string, n int")
    langs, table = langid.train_text(docs, langid.Params(language_rows=50))
    assert langs == ["de", "en", "fr", "sv"]
    every = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n int")
    out = {r.doc_id: r for r in langid.identify(every, ["doc_id"], langs, table).collect()}
    assert not any(out[i].accepted for i in (500, 501, 502)) and all(r.accepted for i, r in out.items() if i < 300)
    assert out[600].language == "sv"
    try:
        langid.train_text(docs, langid.Params(max_languages=3))
    except ValueError:
        return
    raise AssertionError("too many languages")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    langs, table = langid.train_text(docs)
    assert langs == ["und"] and langid.identify(docs, ["doc_id"], langs, table).count() == 0
    assert langid.keep_identified(docs).count() == 0


def test_query_fuses_the_evidence_of_pages(spark, tmp_path):
    """Pages are identified beside documents: markup, address and host decide where the text is too short to."""
    from siftloom.llm import queries

    spark.createDataFrame(rows(300, 4), "doc_id long, text string, lang string, source string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, f"http://{lang}.site.org/{lang}/{i}", f'<html lang="{lang}"><p>{t}</p></html>') for i, t, lang, *_ in rows(200, 5)]
    pages += [(1000, "http://de.site.org/de/1", '<html lang="de">in</html>'), (1001, "http://fr.site.org/fr/1", "<p>12</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op3_language_id(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.page_id is None) == list(range(300))
    got = {r.page_id: r for r in out if r.page_id is not None}
    assert len(got) == len(pages) and all(r.doc_id is None for r in got.values())
    assert got[1000].language == "de" and got[1000].confidence > 0.9 and not got[1001].accepted


def _mix(counts, prior, pull):
    return [(c + pull * q) / (sum(counts) + pull) for c, q in zip(counts, prior, strict=True)]


def _sums(rows, key, n):
    out = {}
    for r in rows:
        if r[key] is not None:
            c = out.setdefault(r[key], [0.0] * n)
            for i, x in enumerate(r["q"]):
                c[i] += x
    return out


def _normal(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


def test_query_equals_posteriors_computed_row_by_row(spark):
    """Text model, host, domain, markup and suffix, from dictionaries over the smallest tables."""
    from siftloom.llm import queries

    sf, p = "/root/testdata/sf0.001", langid.Params()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    pages = langid.page_evidence(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    grams = lambda t: [((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF) >> 16 for a, b, c in zip(t, t[1:], t[2:], strict=False)]
    counts = {}
    for r in docs:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5 != 2:
            counts.setdefault(r.lang, collections.Counter()).update(grams(low(r.text)))
    langs = sorted(counts)
    n, size = len(langs), 1 << 16
    total = [sum(counts[x].values()) + p.smoothing * size for x in langs]
    logp = lambda g: [math.log((counts[x][g] + p.smoothing) / t) for x, t in zip(langs, total, strict=True)]
    logp = functools.cache(logp)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC3
    rows = [{"id": (r.doc_id, None), "text": low(r.text), "host": (r.source, None) if r.source else None, "domain": None, "declared": None, "suffix": None} for r in docs]
    rows += [{"id": (None, r.page_id), "text": low(r.text), "host": (r.host, r.domain) if r.host else None, "domain": r.domain, "declared": r.declared, "suffix": r.suffix} for r in pages]
    for r in rows:
        r["log"] = [p.temper * sum(x) for x in zip(*map(logp, grams(r["text"])), strict=True)] or [0.0] * n
        r["q"] = _normal(r["log"])
    clear = [r for r in rows if any(map(letter, r["text"]))]
    base = _mix([sum(r["q"][i] for r in clear) for i in range(n)], [1 / n] * n, 1.0)
    domain = {k: _mix(c, base, p.host_pull) for k, c in _sums(clear, "domain", n).items()}
    host = {k: _mix(c, domain.get(k[1], base), p.host_pull) for k, c in _sums(clear, "host", n).items()}
    given = {}
    for col in ("declared", "suffix"):
        c = _sums(clear, col, n)
        s = [sum(x[i] for x in c.values()) for i in range(n)]
        given[col] = {k: [math.log((x[i] + p.evidence_pull * sum(x) / sum(s)) / (s[i] + p.evidence_pull)) for i in range(n)] for k, x in c.items()}
    out = {(r.doc_id, r.page_id): r for r in queries.op3_language_id(spark, sf).collect()}
    assert len(out) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 2) for r in out.values())
    for r in rows:
        got = out[r["id"]]
        if r not in clear:
            assert got.language is None and got.confidence == 0
            continue
        logs = [x + math.log(y) for x, y in zip(r["log"], host.get(r["host"], base), strict=True)]
        for col in ("declared", "suffix"):
            logs = [x + y for x, y in zip(logs, given[col].get(r[col], [0.0] * n), strict=True)]
        post = _normal(logs)
        assert abs(got.confidence - max(post)) < 1e-3 and (got.language == langs[post.index(max(post))] or max(post) < 0.51)
