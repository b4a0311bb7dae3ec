import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siftloom.functions import scoring, text, urls
from siftloom.functions.resolve import resolve


def one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_text(spark):
    t = "  Das Haus\tmit  3.5 Zimmern, nicht 4! \n"
    r = one(spark, [(t,), (None,), ("",)], "t string", text.squeeze(F.col("t")).alias("s"), text.numbers(F.col("t")).alias("n"), text.negated(F.col("t")).alias("x"), text.tokens(F.col("t")).alias("k"))
    assert r[0].s == "Das Haus mit 3.5 Zimmern, nicht 4!" and r[0].n == ["3.5", "4"] and r[0].x
    assert r[0].k == ["haus", "zimmern", "nicht"]
    assert r[1].s is None and r[2].s == "" and r[2].k == []


def test_boundaries_are_ascii(spark):
    r = one(spark, [("Geschäft not",), ("knot ono",), ("änot",)], "t string", text.negated(F.col("t")).alias("x"))
    assert [x.x for x in r] == [True, False, True]


def test_sentences(spark):
    s = "This sentence is long enough to count here. Short one. Another sentence that is also long enough!"
    r = one(spark, [(s,)], "t string", text.sentences(F.col("t")).alias("s"))
    assert r[0].s == ["This sentence is long enough to count here.", "Another sentence that is also long enough!"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 200, allow_nan=False), min_size=1, max_size=60))
def test_round2_is_exact(spark, xs):
    xs = [*xs, 0.005, 1.005, 2.675, 0.125, 0.375, 17.505]
    got = [r.r for r in one(spark, [(x,) for x in xs], "x double", text.round2(F.col("x")).alias("r"))]
    from decimal import ROUND_HALF_UP, Decimal

    assert got == [float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in xs]


URLS = [
    ("https://example.com/docs?a=1&utm_source=test#frag", "https://example.com/docs?a=1"),
    ("HTTP://Ex_Ample.com:80", "http://ex_ample.com/"),
    ("https://a.de:8443/p|q r", "https://a.de:8443/p|q r"),
    ("not a url", None),
    (None, None),
]


def test_normalise(spark):
    r = one(spark, URLS, "u string, w string", urls.normalise(F.col("u"), ["utm_source"]).alias("n"), "w", urls.stripped_params(F.col("u"), ["utm_source", "b"]).alias("s"))
    assert [x.n for x in r] == [x.w for x in r]
    assert r[0].s == ["utm_source"]


def test_filter(spark):
    cases = [
        ("https://example.com/docs/a", dict(include=["docs"]), True, "included"),
        ("https://example.com/admin", dict(exclude_paths=["/admin"]), False, "exclude_path"),
        ("https://example.com/admin/x", dict(exclude_paths=["/admin"]), True, None),
        ("https://other.com/", dict(start_url="https://example.com/", same_domain=True), False, "same_domain_only"),
        ("https://example.com:444/", dict(start_url="https://example.com/", same_domain=True), False, "same_domain_only"),
        ("https://example.com/BLOG/1", dict(exclude=["/blog/*"]), False, "exclude_pattern"),
        ("https://example.com/x", dict(include=["docs"]), False, "include_pattern"),
        ("https://example.com/x$", dict(include=["/x$"]), True, "included"),
    ]
    for url, options, allowed, reason in cases:
        x = one(spark, [(url,)], "u string", urls.decide(F.col("u"), **options).alias("d"))[0].d
        assert (x.allowed, x.reason) == (allowed, reason), url


def test_private_addresses(spark):
    ips = [("127.0.0.1", True), ("10.0.0.5", True), ("169.254.1.20", True), ("::1", True), ("fc00::1", True), ("8.8.8.8", False), ("100.64.0.1", True), ("100.128.0.1", False), ("172.31.1.1", True), ("172.32.1.1", False), ("198.19.0.1", True), ("240.0.0.1", True), ("[::ffff:10.0.0.1]", True), ("2001:db8::1", False), ("name", True), ("256.1.1.1", True)]
    r = one(spark, ips, "ip string, w boolean", urls.private_ip(F.col("ip")).alias("p"), "w")
    assert [x.p for x in r] == [x.w for x in r]
    b = one(spark, [("ftp://a/",), ("http://u:p@a/",), ("http://LOCALHOST/",), ("http://[::1]/",), ("http://a.de/",), ("x",)], "u string", urls.blocked_reason(F.col("u")).alias("b"))
    assert [x.b for x in b] == ["unsupported protocol", "credentials", "localhost", "private network", None, "invalid url"]


@pytest.mark.parametrize(("href", "want"), [
    ("/a", "https://h.de/a"), ("b?x=1#f", "https://h.de/p/b?x=1"), ("../c", "https://h.de/c"), ("//x.org/y", "https://x.org/y"), ("mailto:a@b.c", None),
    ("?q", "https://h.de/p/q.html?q"), ("/für", "https://h.de/f%C3%BCr"), ("https://H.DE:443", "https://h.de/"), ("", "https://h.de/p/q.html"), ("\\w", "https://h.de/w"), ("javascript:void(0)", None), ("a b", "https://h.de/p/a%20b"),
])
def test_resolve(href, want):
    assert resolve(href, "https://h.de/p/q.html") == want


def test_search_score_prefers_the_better_hit(spark):
    rows = [("Search extract guide", "https://example.com/docs/guide", "search and extract guide"), ("Random", "https://example.com/a/b/c/d", "nothing")]
    s = scoring.search_score("search extract guide", F.col("t"), F.col("u"), F.col("s"))["total"]
    assert [x[0] for x in one(spark, rows, "t string, u string, s string", s)] == [100.0, 4.0]


def test_source_profile(spark):
    p = scoring.source_profile(F.col("u"), F.col("c"), F.lit("A"), F.lit("2024"), F.lit(51), F.lit(4), F.lit(0.0))
    r = one(spark, [("https://docs.example.com/guide", "https://docs.example.com/guide")], "u string, c string", p.alias("p"))[0].p
    assert (r.source_type, r.trust_score) == ("official", 92) and r.signals.has_author and r.notes[-1] == "classified as official"


def test_scores_stay_in_bounds(spark):
    rows = [(t, u, s) for t in ("", "guide guide", "x" * 4000) for u in ("https://a.de/docs", "http://a.de/x/y/z/w/", "bad") for s in ("", "guide search")]
    r = one(spark, rows, "t string, u string, s string", scoring.search_score("search guide", F.col("t"), F.col("u"), F.col("s"), 9)["total"].alias("x"), scoring.result_score("search guide", F.col("t"), F.col("u"), F.col("s"), "de").alias("y"))
    for x in r:
        assert all(v is None or (0 <= v <= 100 and not math.isnan(v)) for v in (x.x, x.y))
