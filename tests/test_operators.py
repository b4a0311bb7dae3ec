import random
import pytest
from pyspark.sql import functions as F
from siftloom.operators import chunk, claims, contacts, crawl, dedupe, search, sitemap
from siftloom.operators.extract import extract_page
from siftloom.plans import pipelines
from siftloom.sources import snapshots as src

PAGE = """<html lang="de"><head><title>Example Article</title><link rel="canonical" href="/a"><meta name="description" content="About it">
<meta property="article:published_time" content="2024-05-01"><meta name="author" content="Ada"></head><body><header><nav><a href="/x">Legal Privacy</a></nav></header>
<main><article><h1 id="intro">Intro</h1><p>This is the main article text with <a href="/docs">docs</a> and enough words to pass the length limit of the selection, surely.</p>
<h2>Details</h2><ul><li>One<li>Two</ul><pre>x = 1</pre><blockquote>said</blockquote></article></main><footer>Legal Privacy</footer></body></html>"""


def test_extract_page():
    x = extract_page(PAGE, "https://example.com/p")
    assert x["title"] == "Example Article" and "main article text" in x["main_text"] and "Legal Privacy" not in x["main_text"]
    assert [h["text"] for h in x["headings"]] == ["Intro", "Details"] and x["headings"][0]["id"] == "intro"
    assert x["links"] == ["https://example.com/docs"] and x["nav_links"] == ["https://example.com/x"]
    m = x["metadata"]
    assert (m["canonical_url"], m["lang"], m["author"], m["published_at"], m["meta_description"]) == ("https://example.com/a", "de", "Ada", "2024-05-01", "About it")
    for line in ("# Intro", "[docs](https://example.com/docs)", "## Details", "- One", "- Two", "```\nx = 1\n```", "> said"):
        assert line in x["markdown"]
    assert [s["heading_path"] for s in x["sections"]][-1] == ["Intro", "Details"]


def test_fallbacks_and_broken_pages():
    assert "body text" in extract_page("<body>body text <span>more</span></body>", None)["main_text"]
    for html in (None, "", "<", "<p><b>a<br>b", "<div><div>x</div></div>", "plain"):
        extract_page(html, "https://a.de/")
    assert extract_page("<div><div>x</div></div>", None)["main_text"] == "xxx"


def test_windows_cover_the_text(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab c") for _ in range(n)), n) for i, n in enumerate([0, 1, 9, 10, 11, 25, 100, 3])]
    for size, overlap in ((10, 3), (10, 0), (5, 4)):
        got = chunk.fixed_chunks(spark.createDataFrame(rows, "i int, t string, n int"), "t", size, overlap).collect()
        for i, t, n in rows:
            mine = sorted((c.start_char, c.end_char, c.chunk_text) for c in got if c.i == i)
            want, s = [], 0
            while s < n:
                e = min(n, s + size)
                if t[s:e].strip(" "):
                    want.append((s, e, t[s:e].strip(" ")))
                if e >= n:
                    break
                s = max(e - overlap, s + 1)
            assert mine == want


def test_greedy_dedupe_equals_the_scan(spark):
    r = random.Random(9)
    rows = [(g, i, f"http://h/{r.randint(0, 8)}", r.choice([None, f"http://h/c{r.randint(0, 6)}"]), r.choice([None, f"H{r.randint(0, 6)}"])) for g in range(12) for i in range(14)]
    df = spark.createDataFrame(rows, "g int, seq int, url string, canonical_url string, content_hash string")
    for mode in dedupe.MODES:
        want = {}
        seen: dict = {}
        for g, i, u, c, h in rows:
            s = seen.setdefault(g, (set(), set(), set()))
            hit = None
            if mode != "none":
                keys = [("url", u, s[0])] + ([("canonical", c, s[1])] if mode != "content_hash" else []) + ([("content_hash", h and h.lower(), s[2])] if mode != "canonical" else [])
                hit = next((n for n, k, have in keys if k is not None and k in have), None)
                if hit is None:
                    for _, k, have in keys:
                        if k is not None:
                            have.add(k)
            want[g, i] = (hit is not None, hit)
        got = {(x.g, x.seq): (x.is_duplicate, x.matched_on) for x in dedupe.dedupe_pages(df, mode, ["g"]).collect()}
        assert got == want, mode


def test_similar_pairs_lose_none(spark):
    r = random.Random(5)
    vocab = [f"word{i}" for i in range(30)] + ["2024", "15"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 9)))) for i in range(70)]
    rows += [(70 + i, rows[i][1] + " extra") for i in range(20)] + [(95, ""), (96, "")]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and claims.same_claim(x, y)}
    got = {(p.key_a, p.key_b) for p in claims.similar_pairs(spark.createDataFrame(rows, "k int, s string"), "k", "s").collect()}
    assert got == want


def test_copies_of_a_claim_make_one_row_each(spark, tmp_path):
    """60 copies of one sentence and 60 of its near copy: 118 copies and one link, and the links of different texts are those of all pairs."""
    from siftloom.plans.registry import QUERIES as Q

    r = random.Random(8)
    vocab = [f"word{i}" for i in range(40)] + ["2024", "15"]
    one = "The harbour council approved seventeen separate ferry landing permits during winter meetings."
    texts = [one.upper() if i % 3 == 0 else one for i in range(60)] + [one.replace("winter", "summer")] * 60
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(5, 12))) + " ending." for _ in range(120)]
    texts += [x.replace("word1", "other") for x in texts[120:160]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in Q["claim_similar_pairs"](spark, str(tmp_path)).collect()]
    first: dict = {}
    for i, x in enumerate(texts):
        if 30 <= len(x) <= 320:
            first.setdefault(x.lower(), []).append(i)
    assert sorted((a, b) for a, _, b, _, _, copy in got if copy) == sorted((m[0], x) for m in first.values() for x in m[1:])
    reps = sorted(m[0] for m in first.values())
    want = [(a, b) for a in reps for b in reps if a < b and claims.same_claim(texts[a], texts[b])]
    assert sorted((a, b) for a, _, b, _, _, copy in got if not copy) == want and (0, 60) in want and len(want) > 10


def test_claims_and_contradictions(spark):
    say = "The widget 3 launch date is {} May according to the announcement."
    rows = [("w", "s1", 1, 90, say.format(15)), ("w", "s2", 2, 80, say.format(15) + " It was confirmed by the company press office."), ("w", "s3", 3, 60, say.format(20))]
    s = spark.createDataFrame(rows, "query_id string, source_id string, source_pos int, trust_score int, text string")
    e = claims.evidence(s, "widget 3 launch date").join(s.drop("text", "trust_score"), "source_id")
    support = claims.cluster(e)
    c = claims.rank_claims(support, s)
    top = c.orderBy("claim_rank").first()
    assert top.n_support >= 2
    assert claims.contradictions(c, support, s).count() + c.where("n_support = 3").count() >= 1


def test_intent_and_hits(spark):
    i = search.intent("example.com pricing", "de")
    assert (i.domain, i.brand, i.topic, i.languages) == ("example.com", "example", "pricing", ("de", "en"))
    assert i.variants == ("example.com pricing", "site:example.com pricing", '"example.com" pricing', '"example" pricing', "example pricing")
    body = '{"results":[{"title":"T","url":"https://a.de","content":"' + "x" * 600 + '"},{"title":"","url":"https://b.de"},{"url":"u"}]}'
    r = search.parse_hits(spark.createDataFrame([(1, body)], "variant int, body string")).collect()
    assert len(r) == 1 and len(r[0].snippet) == 500
    hits = spark.createDataFrame([(0, 0, "a", "https://www.a.de/x/", ""), (1, 0, "b", "https://a.de/x", ""), (1, 1, "c", "https://c.de", "")], "variant int, position int, title string, url string, snippet string")
    assert [x.title for x in search.merge_hits(hits, 5).collect()] == ["a", "c"]
    assert search.with_fallback(hits.limit(0), hits).count() == 3 and search.with_fallback(hits, hits).count() == 3


def test_lead_queries(spark):
    cases = {
        "20 Friseure im Bereich 96515 Sonneberg": ("Friseure", "Sonneberg", "96515", None, None),
        "Suche Bäcker in Bad Hersfeld": ("Bäcker", "Bad Hersfeld", None, None, None),
        "Zahnarzt 10115 Berlin": ("Zahnarzt", "Berlin", "10115", None, None),
        "Zahnarzt 10115 10117 Berlin": ("Zahnarzt Berlin", None, "10115", None, None),
        'Impressum von "Alpha GmbH"': (None, None, None, None, "Alpha GmbH"),
        'Frau "Anna Becker"': ('Frau "Anna Becker"', None, None, "Anna Becker", None),
        "Ansprechpartner Max Muster": ("Ansprechpartner Max Muster", None, None, "Max Muster", None),
        "Kanzlei Weber und Partner": (None, None, None, None, "Weber und Partner"),
        "  ": (None, None, None, None, None),
        "Ort Ort umkreis Ort": ("Ort Ort", "Ort", None, None, None),
    }
    q = spark.createDataFrame([(k,) for k in cases] + [(None,)], "q string")
    got = {r.q: tuple(r.x)[:5] for r in q.select("q", contacts.lead_query(F.col("q")).alias("x")).collect()}
    assert got.pop(None) == (None,) * 5 and got == cases


def test_contacts(spark):
    html = """<title>Salon Alpha - Impressum</title><body><h1>Salon Alpha</h1><a href="mailto:Info@Salon.de">m</a><a href="tel:+49 3675 123456">t</a>
    <p>Inhaberin: Anna Becker, Musterstraße 1, 96515 Sonneberg</p><div hidden>x@hidden.de</div><p style="display:none">y@hidden.de</p>
    <script type="application/ld+json">{"@type":"Org","name":"Alpha GmbH","address":{"streetAddress":"Weg 2","postalCode":"12345"}}</script><script>z@script.de</script></body>"""
    p = spark.createDataFrame([(1, "https://salon.de/impressum", html)], "page_id long, final_url string, html string")
    r = contacts.page_contacts(p).first()
    assert r.emails == ["info@salon.de"] and "+493675123456" in r.phones and r.page_type == "impressum"
    assert "Alpha GmbH" in r.organization_names and "Salon Alpha" in r.organization_names and r.addresses and r.contact_people == ["Anna Becker"]
    q = contacts.interpret("20 Friseure im Bereich 96515 Sonneberg")
    assert (q.category, q.postal_code, q.location) == ("Friseure", "96515", "Sonneberg")
    assert contacts.lead_searches(q)[:2] == ["Friseure 96515 Sonneberg", "Friseure 96515 Sonneberg webseite kontakt"]


def test_contacts_of_a_site(spark):
    home = '<title>Salon - Start</title><body>Tel. 03675 123456 <a href="/our/team.html#x">Team</a><a href="https://other.de/kontakt">k</a></body>'
    rows = [("https://a.de/", home), ("https://a.de/impressum", "<title>Impressum</title>info@a.de"), ("https://a.de/our/team.html", "<p>Inhaberin: Anna Becker</p>"), ("https://other.de/kontakt", "x@other.de"), ("https://b.de/", None)]
    p = spark.createDataFrame([(u, u, h) for u, h in rows] + [("https://a.de/contact", "https://a.de/impressum", rows[1][1])], "url string, final_url string, html string")
    homes = spark.createDataFrame([(1, "https://a.de/"), (1, "https://a.de/"), (2, "https://b.de/"), (3, "https://none.de/"), (4, None)], "site int, home string")
    got = {r.site: r for r in contacts.site_contacts(homes, p, 20).collect()}
    assert set(got) == {1, 2} and got[2].n_pages == 1 and got[2].contact_pages == [] and got[2].confidence == 37
    a = got[1]
    assert a.n_pages == 3 and a.impressum_found and a.emails == ["info@a.de"] and a.phones and a.contact_people == ["Anna Becker"] and a.title == "Salon - Start"
    assert [x.final_url for x in a.contact_pages] == ["https://a.de/", "https://a.de/impressum", "https://a.de/our/team.html"]
    assert "emails" in a.sources[1].extracted_fields and a.confidence == min(100, 35 + 30 + 15 + 10 + 5 + 6)
    two = {r.site: r for r in contacts.site_contacts(homes, p, 2, ("/our/team.html",)).collect()}[1]
    assert two.n_pages == 2 and two.contact_people == ["Anna Becker"] and not two.impressum_found
    assert contacts.site_contacts(homes.limit(0), p).count() == 0


def test_plain_html(spark):
    html = "<title> A  b </title><style>s</style><body><nav>menu</nav> one<script>x</script>\n<p>two</p><noscript>no</noscript></body>"
    p = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in pipelines.plain_html(p, 8).collect()}
    assert got == {1: ("A b", "menu one", True), 2: (None, "", False)}


def test_rendered_request():
    assert src.rendered_request(start_url="a", max_pages=3, wait_ms=5) == {"input": {"wait_ms": 5, "url": "a"}, "used_alias": True, "ignored": ["max_pages"]}
    assert src.rendered_request(url="b", start_url="a") == {"input": {"url": "b"}, "used_alias": False, "ignored": []}
    with pytest.raises(ValueError):
        src.rendered_request(max_pages=1)


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>https://a.de/s1.xml</loc></sitemap><sitemap><loc> https://b.de/x.xml </loc></sitemap><sitemap><loc>https://a.de/s2.xml</loc></sitemap></sitemapindex>"
    nested = "<sitemapindex><sitemap><loc>https://a.de/s2.xml</loc></sitemap><sitemap><loc>https://a.de/root.xml</loc></sitemap></sitemapindex>"
    urlset = "<urlset><url><loc>https://a.de/docs/1?a=1&amp;b=2#f</loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url><url><loc>https://a.de/blog/1</loc></url></urlset>"
    cut = "<urlset><url><loc>https://a.de/product/1</loc><lastmod>20"
    df = spark.createDataFrame([("https://a.de/root.xml", index), ("https://a.de/s1.xml", nested), ("https://a.de/s2.xml", urlset), ("https://a.de/cut.xml", cut)], "url string, xml string")
    e = sitemap.entries(df.withColumnRenamed("url", "sitemap")).collect()
    assert {x.url for x in e} == {"https://a.de/docs/1?a=1&b=2", "https://a.de/blog/1", "https://a.de/product/1"}
    roots = spark.createDataFrame([("https://a.de/root.xml",)], "root string")
    got = [x.url for x in sitemap.expand(df, roots).orderBy("order").collect()]
    assert got == ["https://a.de/root.xml", "https://a.de/s1.xml", "https://a.de/s2.xml"]


def test_crawl_order_and_dead_ends(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("c", "a", 1), ("d", "e", 0)], "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([(1, "a"), (2, "c")], "crawl_id int, url string")
    walk = [(x.url, x.depth) for x in crawl.bfs(edges, seeds, 2, 10).where("crawl_id = 1").orderBy("order").collect()]
    assert walk == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert crawl.bfs(edges, seeds, 3, 2).where("crawl_id = 1").count() == 2
    dead = spark.createDataFrame([(1, "b"), (1, "c")], "crawl_id int, url string")
    assert {x.url for x in crawl.bfs(edges, seeds, 3, 10, dead).where("crawl_id = 1").collect()} == {"a", "b", "c"}


def test_robots(spark):
    body = "# c\nUser-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf\nSitemap: /s.xml"
    rules = crawl.robots_rules(spark.createDataFrame([("https://a.de", body)], "origin string, body string"))
    pages = spark.createDataFrame([(f"https://a.de{p}",) for p in ("/", "/p", "/p/no", "/p/ok/1", "/x/y.pdf")] + [("https://b.de/p",)], "url string")
    assert {r.url for r in crawl.robots_filter(pages, rules).collect()} == {"https://a.de/", "https://a.de/p/ok/1", "https://b.de/p"}


def test_documents(spark):
    pdf = b"%PDF-1.4\n1 0 obj<</Type /Page>>endobj 2 0 obj<</Type /Pages>>endobj\n3 0 obj<</Length 40>>\nstream\nBT (Hello \\(PDF\\)) Tj [(wor) -5 (ld)] TJ ET\nendstream\nendobj\n4 0 obj<</Title (My Title)>>endobj"
    rows = [("https://a.de/x", None, None, pdf), ("https://a.de/t", "text/plain", None, b"a  b \r\n\r\n\r\n\r\nc"), ("https://a.de/h", None, None, b"  <html><title>T</title><body>body words</body>")]
    r = {x.final_url[-1]: x for x in src.document_text(spark.createDataFrame(rows, "final_url string, content_type string, content_disposition string, content binary")).collect()}
    assert (r["x"].kind, r["x"].title, r["x"].page_count) == ("pdf", "My Title", 1) and "Hello (PDF)" in r["x"].text and "world" in r["x"].text
    assert r["t"].text == "a b\n\nc" and (r["h"].kind, r["h"].title) == ("html", "T")


def test_page_directory_source(spark, tmp_path):
    for host in ("a.de", "b.de"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "i.html").write_text("<p>x</p>")
    src.register(spark)
    df = spark.read.format("page_directory").option("path", str(tmp_path)).load()
    assert {r.url for r in df.collect()} == {"https://a.de/i.html", "https://b.de/i.html"}


def test_stream_dedupe(spark, tmp_path):
    from siftloom.streaming.incremental import dedupe_stream

    rows = [("2024-01-01 00:00:00", "same"), ("2024-01-01 00:01:00", "same"), ("2024-01-01 00:02:00", "other")]
    spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = dedupe_stream(s, "ts").writeStream.format("memory").queryName("dd").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == 2


def test_compound_queries_on_the_smallest_tables(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = pipelines.search_and_extract(p, "that this tion with", 5, "en").collect()
    assert len(out) == 5 and all(0 <= r.trust_score <= 100 for r in out)
    assert pipelines.deep_research(p, "that this tion with", 4, 5).count() <= 5


def test_sources_are_deepened_by_sitemaps(spark):
    words = "The widget launch guide. " + " ".join(f"term{i}" for i in range(300))
    html = "<html><head><title>{}</title></head><body><main><h1>{}</h1><p>{} {}</p></main></body></html>"
    rows = [(i, f"https://docs.a.de/guide/{i}", html.format(f"Guide {i}", f"Guide {i}", words, i)) for i in range(4)] + [(9, "https://forum.b.de/t/1", html.format("Forum", "Forum", words, "x"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    xml = "<urlset>" + "".join(f"<url><loc>https://docs.a.de/guide/{i}</loc><lastmod>202{i}-01-01</lastmod></url>" for i in range(4)) + "</urlset>"
    maps = spark.createDataFrame([("https://docs.a.de/sitemap.xml", xml)], "sitemap string, xml string")
    found = pipelines.sources(pipelines.extracted(pages.where("page_id in (0, 9)")), "widget launch guide")
    assert {r.source_type for r in found.collect()} == {"official", "community"}
    got = [r.url for r in pipelines.deepen(found, maps, pages, "widget launch guide").collect()]
    assert set(got) == {"https://docs.a.de/guide/0", "https://docs.a.de/guide/2", "https://docs.a.de/guide/3", "https://forum.b.de/t/1"} and got[-1].startswith("https://forum")
    robots = spark.createDataFrame([("https://docs.a.de", "Sitemap: https://docs.a.de/s.xml")], "origin string, body string")
    assert [r.sitemap for r in pipelines.sitemap_candidates(found, robots).collect()] == ["https://docs.a.de/s.xml"]


def test_domain_hits_and_byte_cut(spark):
    from siftloom.functions import text

    x = spark.createDataFrame([("https://pow24.de/", None, ("About",), "t"), ("https://pow24.de/x", "X", (None,), "t")], "url string, title string, metadata struct<meta_description:string>, main_text string")
    r = search.domain_hits(x, "POW24.de").collect()
    assert len(r) == 1 and (r[0].title, r[0].snippet) == ("POW24.de", "About")
    s = "aé漢😀b"
    for n in range(12):
        cut, more = text.truncate_bytes(F.col("s"), n)
        got = spark.createDataFrame([(s,)], "s string").select(cut.alias("c"), more.alias("m")).first()
        assert got.c == s.encode()[:n].decode(errors="ignore") and got.m == (n < len(s.encode()))


def test_searches_find_words_beyond_the_snippet(spark):
    """Pages whose only match lies after the first 500 characters are candidates."""
    from siftloom.operators import search
    from siftloom.plans import pipelines

    late = "filler words of a page. " * 60 + "zebra"
    html = "<html><head><title>{}</title></head><body><article><h1>H</h1><p>{}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "https://h.example/a", html.format("One", late)), (2, "https://h.example/b", html.format("Two", "nothing here at all"))], "page_id long, url string, html string")
    assert [r.page_id for r in pipelines.search_and_extract(pages, "zebra", 10, "en").collect()] == [1]
    hits = spark.createDataFrame([(1, "One", "https://h.example/a", late[:500], late), (2, "Two", "https://h.example/b", "none", "none")], "page_id long, title string, url string, snippet string, body string")
    assert [r.page_id for r in search.search_corpus(hits, "zebra").collect()] == [1]


def test_claim_queries_use_every_sentence_and_whole_texts(spark, tmp_path):
    """Later sentences count, and so does the end of texts that begin alike."""
    from siftloom.plans.registry import QUERIES as Q

    same = "The harbour council approved seventeen separate ferry landing permits during winter meetings."
    a = f"An opening sentence about mountains and their many glaciers in the northern summer season. {same}"
    b = f"Another beginning that speaks of desert railways and of copper mines beyond the river. {same}"
    c = "An opening sentence about something wholly different, namely beekeeping in coastal villages today."
    spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, c, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {tuple(r) for r in Q[name](spark, str(tmp_path)).collect()}
    assert {x[:4] for x in run("claim_similar_pairs")} == {(1, 1, 2, 1)}
    assert {x[:2] for x in run("claim_signature")} == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)}
    assert {x[:2] for x in run("contradiction_notes")} == {(1, 0), (2, 0)}
    assert not any(x[2] == "content_hash" for x in run("dedupe_greedy"))


def _walk(pages, edges, start, max_depth, max_pages):
    """A queue of addresses, as a crawler of one site keeps it."""
    by, queue, seen = {p["url"]: p for p in pages}, [(start, 0)], {start}
    kept, visits, urls_, canon, hashes = 0, [], set(), set(), set()
    while queue and kept < max_pages:
        url, depth = queue.pop(0)
        p = by.get(url)
        if p is None:
            visits.append((url, depth, "missing"))
            continue
        c = p["canonical_url"]
        if url in urls_ or (c and c in canon) or p["content_hash"] in hashes:
            visits.append((url, depth, "duplicate"))
            continue
        urls_.add(url)
        hashes.add(p["content_hash"])
        if c:
            canon.add(c)
        kept += 1
        visits.append((url, depth, "kept"))
        if depth < max_depth:
            for to in edges.get(url, []):
                if to not in seen:
                    seen.add(to)
                    queue.append((to, depth + 1))
    return visits


def test_site_walks_equal_a_queue(spark):
    import random

    r = random.Random(4)
    url = "https://a.de/p{}".format
    pages = [{"url": url(i), "canonical_url": url(r.randint(0, 30)) if r.random() < 0.2 else None, "content_hash": f"h{r.randint(0, 25)}"} for i in range(40) if i % 7]
    links = {url(i): [url(r.randint(0, 39)) for _ in range(4)] for i in range(40)}
    df = spark.createDataFrame([(p["url"], p["canonical_url"], p["content_hash"]) for p in pages], "url string, canonical_url string, content_hash string")
    e = spark.createDataFrame([(a, b, k) for a, bs in links.items() for k, b in enumerate(bs)], "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([(f"c{i}", url(i)) for i in (1, 2, 7)], "crawl_id string, url string")
    v = crawl.site_walk(lambda w: df.join(w, "url", "left_semi"), e, seeds, lambda x: dedupe.dedupe_pages(x, "canonical_and_hash", ["crawl_id"]), 3, 6)
    got = {}
    for x in v.orderBy("crawl_id", "seq").collect():
        got.setdefault(x.crawl_id, []).append((x.url, x.depth, x.status))
    want = {f"c{i}": _walk(pages, links, url(i), 3, 6) for i in (1, 2, 7)}
    assert got == want and any(s == "missing" for x in want.values() for *_, s in x) and any(s == "duplicate" for x in want.values() for *_, s in x)
    n = {x.crawl_id: x for x in crawl.walk_counters(v).collect()}
    for c, w in want.items():
        kinds = [s for *_, s in w]
        assert (n[c].pages_fetched, n[c].pages_visited, n[c].duplicates_skipped, n[c].errors, n[c].max_depth_reached) == (kinds.count("kept"), len(w), kinds.count("duplicate"), kinds.count("missing"), max(d for _, d, _ in w))


def test_importance_of_links_in_a_walk_stays_within_its_site(spark):
    import random

    r = random.Random(1)
    rows = [(f"s{r.randint(0, 2)}", i // 6, i % 3, i, f"https://x.de/{r.randint(0, 4)}", r.choice(["nav", "nav", "rss", "content", "sitemap"]), r.randint(1, 50)) for i in range(90)]
    want = {}
    for site, _, _, _, u, kind, size in sorted(rows, key=lambda x: x[1:4]):
        m = want.setdefault(site, {})
        if kind == "nav":
            m[u] = [m[u][0], m[u][1] + 40] if u in m else ["nav", 120]
        elif kind in ("rss", "sitemap"):
            m[u] = [kind, {"rss": 180, "sitemap": 200}[kind]]
        elif u not in m:
            m[u] = ["content", 100 + size]
    df = spark.createDataFrame(rows, "site string, o int, step int, pos int, url string, kind string, size int")
    got = {}
    for x in crawl.walk_importance(df, ["site"], ["o", "step", "pos"]).collect():
        got.setdefault(x.site, {})[x.url] = [x.reason, x.score]
    assert got == want


def test_discovery_reads_what_its_walk_reaches(spark):
    page = "<html><head><title>{}</title></head><body><nav><a href='/n'>n</a></nav><main><p>{}</p></main></body></html>"
    rows = [(i, u, page.format(u, "word " * (i + 1))) for i, u in enumerate(["https://a.de/", "https://a.de/n", "https://a.de/far", "https://b.de/", "https://a.de/no"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    e = spark.createDataFrame([("https://a.de/", "https://a.de/n", 0), ("https://a.de/", "https://a.de/no", 1), ("https://a.de/n", "https://a.de/far", 0)], "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([("a", "https://a.de/"), ("b", "https://b.de/")], "crawl_id string, url string")
    robots = spark.createDataFrame([("https://a.de", "User-agent: *\nDisallow: /no\nSitemap: /map.xml")], "origin string, body string")
    out = pipelines.discover_site(pages, e, seeds, 10, 2, crawl.robots_rules(robots), robots)
    assert {r.crawl_id: r.pages_scanned for r in out["signals"].collect()} == {"a": 2, "b": 1}
    got = {(r.crawl_id, r.url): (r.reason, r.score) for r in out["important"].collect()}
    assert got["a", "https://a.de/n"] == ("nav", 160) and got["b", "https://b.de/n"] == ("nav", 120) and got["a", "https://a.de/map.xml"] == ("sitemap", 200)
    assert ("a", "https://a.de/far") not in got and ("a", "https://a.de/no") not in got


def test_pages_are_passed_over_unparsed_only_if_they_hold_no_token(spark):
    html = ["<p>wid<b>get</b> x</p>", "<p>w&#105;dget</p>", "<p>other &amp; more</p>", "<title>WIDGET</title>", None, "<p>a < b widget</p>", "<p title='widget'>x</p>"]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert {r.page_id for r in pipelines.may_match(pages, "widget").collect()} == {0, 1, 3, 5, 6}


def test_hits_choose_sources_and_override_scores(spark):
    body = "<html><head><title>T{}</title></head><body><main><p>{}</p></main></body></html>"
    pages = spark.createDataFrame([(i, f"https://a.de/{i}", body.format(i, f"words {i} " * 30)) for i in range(3)], "page_id long, url string, html string")
    hits = spark.createDataFrame([("https://a.de/1", 77, None), ("https://a.de/2", None, 5)], "url string, relevance_score int, content_quality_score int")
    got = {r.url: r for r in pipelines.research_sources(pages, "nothing shared", hits=hits).collect()}
    assert set(got) == {"https://a.de/1", "https://a.de/2"} and got["https://a.de/1"].relevance_score == 77 and got["https://a.de/2"].content_quality_score == 5


def test_bounds_and_small_functions(spark):
    from siftloom.functions import text

    p = spark.createDataFrame([(1, "https://a.de/", "<p>x</p>")], "page_id long, url string, html string")
    for call in (lambda: pipelines.research_sources(p, "x", 21), lambda: pipelines.research_sources(p, "x", 0), lambda: pipelines.find_leads(p, p, "x", True)):
        with pytest.raises(ValueError):
            call()
    assert [sitemap.type_of_query(q) for q in ("Install GUIDE", "privacy", "company news", "Pricing plan", "weather")] == ["docs", "policy", "blog", "product", None]
    df = spark.createDataFrame([("x" * 181, {"Body": "b", "url": "u"}), ("", {}), (None, None)], "t string, d map<string,string>")
    rows = df.select(text.length_quality(F.col("t")).alias("q"), text.redacted(F.col("d")).alias("d")).collect()
    assert [r.q for r in rows] == [2, 0, None] and rows[0].d == {"url": "u"} and rows[2].d is None


def test_a_key_of_many_rows_keeps_its_first(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit("same").alias("k"), F.lit(None).cast("string").alias("x"))
    assert [r.id for r in dedupe.keep_first(df, F.col("k"), ["id"]).collect()] == [0]
    assert [r.id for r in dedupe.keep_first(df, [F.col("k"), F.col("x")], ["x", "id"]).collect()] == [0]


def _against_sql(spark, folder, name, table):
    """Rows of a query and of its SQL over one table in ``folder``."""
    import duckdb
    from siftloom.plans import oracle, registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, got.collect()), key=str), sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL[name]})").fetchall(), key=str)


def test_lead_groups_list_the_address_of_every_hit(spark, tmp_path):
    """Two hits of one name with one address: both are listed, and a lead's candidate addresses stay distinct."""
    page = "<html><head><title>{}</title></head><body><article><p>x</p></article></body></html>"
    rows = [(i, u, page.format(t)) for i, (u, t) in enumerate([("https://a.de/1", "Salon Alpha"), ("https://a.de/2", "Salon Alpha"), ("https://a.de/1", "salon alpha"), ("https://b.de/", "Beta Shop")])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = _against_sql(spark, tmp_path, "lead_groups", "pages")
    assert got == want and any(x[-1] == "https://a.de/1 https://a.de/2 https://a.de/1" for x in got)
    hits = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate([("https://a.de/1", "Salon Alpha"), ("https://a.de/1", "Salon Alpha")])], "position int, url string, title string")
    assert [r.candidate_urls for r in contacts.lead_groups(hits).collect()] == [["https://a.de/1"]]


def test_lead_groups_put_hits_without_a_place_last(spark, tmp_path):
    """As its SQL orders them: a page without an id follows the others, and one without an address is counted only."""
    page = "<html><head><title>Salon Alpha</title></head><body><article><p>x</p></article></body></html>"
    rows = [(None, "https://n.de/"), (1, "https://a.de/1"), (0, "https://a.de/1"), (2, None)]
    spark.createDataFrame([(i, u, page) for i, u in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = _against_sql(spark, tmp_path, "lead_groups", "pages")
    assert got == want == [("salon alpha", "Salon Alpha", 4, 0, 4, "https://a.de/1 https://a.de/1 https://n.de/")]


def test_document_kinds_of_odd_texts(spark, tmp_path):
    """Missing, empty and short accented texts, for every remainder that the SQL reads of an id."""
    texts = [None, "", "èé", "plain", "日本語", "\x00\x01", "a<b"]
    rows = [(i, texts[i // 5 % len(texts)]) for i in range(-200, 5 * 3 * 7 * 11 * 13)] + [(None, "é"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _against_sql(spark, tmp_path, "document_kinds", "documents")
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []


def test_document_kinds_of_texts_that_look_like_files(spark, tmp_path):
    """First bytes come from the id, so such texts change no kind; the operator still tells such files by them."""
    texts = ["<p>x", " \n<!doctype html>", "%PDF-1.4 x", "\t%PDF-", "text"]
    rows = [(i, texts[i // 5 % len(texts)]) for i in range(-50, 1000)] + [(None, x) for x in texts]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _against_sql(spark, tmp_path, "document_kinds", "documents")
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []
    f = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in enumerate(texts)], "i int, b binary")
    none = F.lit(None).cast("string")
    assert [r[0] for r in f.orderBy("i").select(src.document_kind(F.lit("https://h.example/f"), none, none, F.col("b"))["kind"]).collect()] == ["html", "html", "pdf", "pdf", "text"]


def test_a_type_that_nothing_tells_is_the_callers(spark):
    """Files keep the general type unless the caller knows that contents are decoded texts."""
    f = spark.createDataFrame([(bytearray("èé".encode()), None), (bytearray("èé".encode()), "application/octet-stream"), (bytearray(b"plain"), None), (bytearray("èé".encode()), "image/x")], "b binary, ct string")
    kind = lambda *unknown: [tuple(r[0]) for r in f.select(src.document_kind(F.lit("https://h.example/f"), F.col("ct"), F.lit(None).cast("string"), F.col("b"), *unknown)).collect()]
    assert kind() == [("text", "application/octet-stream")] * 2 + [("text", "text/plain"), ("text", "image/x")]
    assert kind("text/plain") == [("text", "text/plain")] * 3 + [("text", "image/x")]
