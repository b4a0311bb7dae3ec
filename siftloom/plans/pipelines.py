"""The compound queries: search and extract, sources, claims, deep research, leads, site discovery.

Each is a function of tables and parameters; pages that the originals of such
tools would fetch are rows of ``pages`` or ``snapshots`` here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..operators import claims, contacts, crawl, dedupe, search, sitemap
from ..operators.chunk import fixed_chunks, section_chunks
from ..operators.extract import MAIN, extract
from ..sources.snapshots import snapshots

INSTITUTIONAL = ["official", "government", "scientific"]


def page_quality(x: DataFrame) -> DataFrame:
    """Add content_quality_score and word_count to extracted pages."""
    q = scoring.content_quality(F.col("main_text"), F.size("headings"), F.size("links"), scoring.metadata_fields(F.col("metadata")), F.col("truncated"))
    return x.withColumn("content_quality_score", q).withColumn("word_count", scoring.word_count(F.col("main_text")))


def page_profile(x: DataFrame, url: str = "final_url") -> DataFrame:
    """Add the source profile to pages with quality."""
    m = F.col("metadata")
    return x.withColumn("profile", scoring.source_profile(F.col(url), m["canonical_url"], m["author"], m["published_at"], F.col("content_quality_score"), F.col("word_count"), F.col("boilerplate_ratio")))


def extracted(pages: DataFrame, max_chars: int | None = None, parts: tuple[str, ...] = MAIN) -> DataFrame:
    """Snapshots with extraction, quality and profile, written once so that later steps don't parse again."""
    x = extract(snapshots(pages), parts, max_chars)
    return dedupe.checkpoint_table(page_profile(page_quality(x)), "extracted")


#: Entities that stand for no letter or digit.
_NO_LETTER = "amp|lt|gt|quot|nbsp|apos|#39"


def may_match(pages: DataFrame, query: str) -> DataFrame:
    """Pages whose title or text may hold a token of the query, found without parsing.

    No page that has one is lost: its token stands in the source once tags are
    taken out, unless an entity spells a part of it, and such pages stay.
    """
    hay = F.lower(F.concat_ws(" ", F.regexp_replace("html", r"</?[A-Za-z!][^>]*>", ""), "html"))
    tokens = "|".join(re.escape(t) for t in text.query_tokens(query))
    some = hay.rlike(tokens) if tokens else F.lit(False)
    return pages.where(some | F.col("html").rlike(rf"&(?!(?:{_NO_LETTER});)[#A-Za-z]"))


def search_and_extract(pages: DataFrame, query: str, limit: int = 10, language: str = "de", max_chars: int = 8000, mode: str = "text") -> DataFrame:
    """Best pages for a query with their text, quality and trust; chunks for mode ``chunks``.

    Pages are found by title and whole text, one per content hash, and ranked by
    title, address and the first 500 characters of their text, then address.
    """
    parts = (*MAIN, "markdown") if mode == "markdown" else (*MAIN, "sections") if mode == "chunks" else MAIN
    x = extracted(may_match(pages, query), None, parts)
    hits = x.withColumn("snippet", F.substring("main_text", 1, 500)).where("title is not null")
    hits = hits.where(F.arrays_overlap(text.tokens(F.concat_ws(" ", "title", "main_text")), scoring.array_literal(text.query_tokens(query))))
    hits = dedupe.keep_first(hits, F.col("content_hash"), ["page_id"])
    top = search.rerank(hits.withColumnRenamed("url", "page_url").withColumn("url", F.col("final_url")), query, language, limit)
    rel = scoring.relevance(query, F.col("title"), F.col("url"), F.col("headings")["text"], F.col("snippet"), F.col("metadata.meta_description"), F.col("main_text"))
    out = top.withColumn("relevance_score", rel)
    if mode == "chunks":
        return section_chunks(out, ["page_id", "url", "quality_score"])
    body = F.col("markdown") if mode == "markdown" else F.col("main_text")
    cut, more = text.truncate(body, max_chars)
    return out.select("page_id", "title", "url", "quality_score", "relevance_score", "content_quality_score", F.col("profile.trust_score").alias("trust_score"), F.col("profile.source_type").alias("source_type"), cut.alias("content"), more.alias("content_truncated"))


def sources(x: DataFrame, query: str) -> DataFrame:
    """Extracted pages as research sources."""
    rel = scoring.relevance(query, F.col("title"), F.col("final_url"), F.col("headings")["text"], F.lit(None).cast("string"), F.col("metadata.meta_description"), F.col("main_text"))
    return x.select(
        text.short_id("src_", F.col("final_url")).alias("source_id"), "title", F.col("final_url").alias("url"), F.col("metadata.canonical_url").alias("canonical_url"), "content_hash",
        F.col("profile.source_type").alias("source_type"), F.col("profile.trust_score").alias("trust_score"), rel.alias("relevance_score"), "content_quality_score", "extracted_via",
        text.preview(F.col("main_text")).alias("extracted_preview"), F.col("main_text").alias("text"),
    )


def research_sources(pages: DataFrame, query: str, max_sources: int = 8, official_first: bool = True, hits: DataFrame | None = None) -> DataFrame:
    """Best distinct sources for a query that they share a token with.

    ``hits(url, relevance_score, content_quality_score)``, where given, choose the
    pages instead, and their scores stand in for the page's where not null.
    """
    text.bounded("max_sources", max_sources, 1, 20)
    if hits is None:
        s = sources(extracted(may_match(pages, query)), query)
        s = s.where(F.arrays_overlap(text.tokens(F.concat_ws(" ", "title", "text")), scoring.array_literal(text.query_tokens(query))))
    else:
        h = hits.select(F.col("url").alias("_u"), F.col("relevance_score").alias("_r"), F.col("content_quality_score").alias("_q"))
        s = sources(extracted(pages.join(h, pages["url"] == h["_u"], "left_semi")), query).join(h, F.col("url") == F.col("_u"))
        s = s.withColumn("relevance_score", F.coalesce("_r", "relevance_score")).withColumn("content_quality_score", F.coalesce("_q", "content_quality_score")).drop("_u", "_r", "_q")
    s = dedupe.keep_first(s, dedupe.research_key(F.col("canonical_url"), F.col("content_hash"), F.col("url")), [F.collate("url", "UNICODE"), "url"])
    first, second = ("trust_score", "relevance_score") if official_first else ("relevance_score", "trust_score")
    return s.orderBy(F.desc(first), F.desc(second), F.collate("url", "UNICODE")).limit(max_sources)


def institutional(found: DataFrame, least: int) -> DataFrame:
    """Official, government and scientific sources of at least this trust."""
    return found.where(F.col("source_type").isin(*INSTITUTIONAL) & (F.col("trust_score") >= least))


def sitemap_candidates(found: DataFrame, robots: DataFrame, limit: int = 3) -> DataFrame:
    """Sitemaps of institutional sources: source_id, rank, sitemap; those that robots files name, else the usual place."""
    s = institutional(found, 78).select("source_id", urls.origin(F.col("url")).alias("origin"))
    named = s.join(crawl.robots_sitemaps(robots), "origin", "left")
    named = named.select("source_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("url", F.concat("origin", F.lit("/sitemap.xml"))).alias("sitemap"))
    w = Window.partitionBy("source_id").orderBy("pos", "sitemap")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("pos")


def deepen(found: DataFrame, sitemaps: DataFrame, pages: DataFrame, query: str, max_sources: int = 12, robots: DataFrame | None = None) -> DataFrame:
    """Sources with sitemap targets of the first two added.

    Of the two best sources those that are institutional are deepened: by the two
    newest targets, of the type that the query asks for, of their first sitemap
    candidate.  ``sitemaps(sitemap, xml)``; targets are looked up in ``pages``.
    """
    top = institutional(found.orderBy(F.desc("trust_score"), F.desc("relevance_score"), F.collate("url", "UNICODE")).limit(2), 75)
    none = found.sparkSession.createDataFrame([], "origin string, body string")
    first = sitemap_candidates(top, robots if robots is not None else none).where("rank = 1").select("source_id", "sitemap")
    e = sitemap.entries(sitemaps.join(first.select("sitemap").distinct(), "sitemap", "left_semi")).join(first, "sitemap")
    t = sitemap.targets(sitemap.merge_entries(e, ["source_id"], ["pos"]), ["source_id"], sitemap.type_of_query(query), limit=2)
    wanted = pages.join(t.select(F.col("url").alias("_u")), urls.normalise(pages["url"]) == F.col("_u"), "left_semi")
    both = found.withColumn("_o", F.lit(0)).unionByName(sources(extracted(wanted), query).withColumn("extracted_via", F.lit("sitemap")).withColumn("_o", F.lit(1)))
    kept = dedupe.keep_first(both, dedupe.research_key(F.col("canonical_url"), F.col("content_hash"), F.col("url")), ["_o", F.collate("url", "UNICODE")]).drop("_o")
    return kept.orderBy(F.desc("trust_score"), F.desc("relevance_score"), F.collate("url", "UNICODE")).limit(max_sources)


def research_claims(found: DataFrame, query: str, max_claims: int = 12) -> dict[str, DataFrame]:
    """claims, support, contradictions and coverage of a set of sources (at most twenty)."""
    text.bounded("max_claims", max_claims, 1, 20)
    if found.limit(21).count() > 20:
        raise ValueError("at most twenty sources")
    s = found.withColumn("query_id", F.lit(query))
    order = Window.partitionBy("query_id").orderBy(F.desc("trust_score"), F.desc("relevance_score"), F.collate("url", "UNICODE"))
    s = dedupe.checkpoint_table(s.withColumn("source_pos", F.row_number().over(order)), "sources")
    e = claims.evidence(s, query).join(s.select("source_id", "query_id", "source_pos"), "source_id")
    support = dedupe.checkpoint_table(claims.cluster(e), "support")
    ranked = dedupe.checkpoint_table(claims.rank_claims(support, s, max_claims), "claims")
    against = claims.contradictions(ranked, support, s)
    return {"claims": ranked, "support": support.join(ranked.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_semi"), "contradictions": against, "coverage": claims.coverage(ranked, against), "sources": s}


def deep_sources(pages: DataFrame, query: str, max_sources: int = 8, sitemaps: DataFrame | None = None, robots: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """The sources of deep research: the best ones, deepened by sitemaps where given."""
    if sitemaps is None:
        return research_sources(pages, query, min(max_sources + 4, 20), hits=hits)
    found = dedupe.checkpoint_table(research_sources(pages, query, max_sources, hits=hits), "sources")
    return deepen(found, sitemaps, pages, query, min(max_sources + 4, 20), robots)


def deep_research(pages: DataFrame, query: str, max_sources: int = 8, max_claims: int = 12, sitemaps: DataFrame | None = None, robots: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """One row per claim with confidence, support and contradictions."""
    r = research_claims(deep_sources(pages, query, max_sources, sitemaps, robots, hits), query, max_claims)
    sup = r["support"].groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "evidence"))).alias("support"))
    con = r["contradictions"].groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "note"))).alias("contradictions"))
    none = F.array().cast("array<struct<source_id:string,note:string>>")
    return r["claims"].join(sup, "claim_id").join(con, "claim_id", "left").select("claim_rank", "claim_id", "claim", "confidence", "n_support", "support", F.coalesce("contradictions", none).alias("contradictions"))


def research_summary(r: dict[str, DataFrame]) -> DataFrame:
    """Whether a question is answered, how surely, and what is missing."""
    inst = r["sources"].agg(F.coalesce(F.bool_or(F.col("source_type").isin(*INSTITUTIONAL)), F.lit(False)).alias("institutional"))
    n = r["claims"].agg(F.count(F.lit(1)).alias("n"))
    c = r["coverage"].agg(F.coalesce(F.sum("well_supported"), F.lit(0)).alias("well"), F.coalesce(F.sum("conflicting"), F.lit(0)).alias("conflicting"))
    return n.crossJoin(c).crossJoin(inst).select(scoring.research_summary(F.col("n"), F.col("well"), F.col("conflicting"), F.col("institutional")).alias("s")).select("s.*")


def crawl_visits(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 10, mode: str = "canonical_and_hash") -> DataFrame:
    """Visits of each crawl in order, with their status; pages are extracted as they are reached."""
    text.bounded("max_depth", max_depth, 0, 100)
    text.bounded("max_pages", max_pages, 1, 1_000_000)

    def load(wanted: DataFrame) -> DataFrame:
        x = extracted(dedupe.keep_first(pages.join(wanted, "url", "left_semi"), F.col("url"), ["page_id"]))
        return x.select("url", "title", "content_hash", F.col("metadata.canonical_url").alias("canonical_url"), "content_quality_score", "word_count")

    return crawl.site_walk(load, edges, seeds, lambda rows: dedupe.dedupe_pages(rows, mode, ["crawl_id"]), max_depth, max_pages)


def crawl_site(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 10, mode: str = "canonical_and_hash") -> DataFrame:
    """Pages of each crawl in order, with duplicates marked; ``max_pages`` counts those that are kept."""
    v = crawl_visits(pages, edges, seeds, max_depth, max_pages, mode).where("status <> 'missing'")
    w = Window.partitionBy("crawl_id").orderBy("seq")
    return v.withColumn("order", F.row_number().over(w).cast("long") - 1).drop("seq", "status")


def crawl_counters(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 10, mode: str = "canonical_and_hash") -> DataFrame:
    """Counters of each crawl."""
    return crawl.walk_counters(crawl_visits(pages, edges, seeds, max_depth, max_pages, mode))


def discover_site(pages: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 20, max_pages: int = 20, rules: DataFrame | None = None, robots: DataFrame | None = None) -> dict[str, DataFrame]:
    """Important pages, navigation, feeds and signals of each site, as a walk from its seed finds them.

    At most ``max_pages`` addresses are taken from the queue; those that ``rules``
    (of :func:`crawl.robots_rules`) forbid count, but aren't read.  ``robots``
    names sitemaps.
    """
    text.bounded("max_pages", max_pages, 1, 1_000_000)
    allow = (lambda df, url="url": crawl.robots_filter(df, rules, url)) if rules is not None else (lambda df, url="url": df)
    walk = dedupe.checkpoint_table(crawl.bfs(allow(edges, "dst_url"), seeds, max_pages, max_pages), "walk")
    reached = dedupe.keep_first(pages.join(allow(walk.select("url").distinct()), "url", "left_semi"), F.col("url"), ["page_id"])
    x = extract(snapshots(reached), ("title", "main_text", "metadata", "nav_links", "feeds", "login", "search"))
    x = dedupe.checkpoint_table(x, "signals").join(walk.select("crawl_id", "url", "order"), "url")
    none = F.lit(None).cast("int")
    sighted = lambda links, kind, step: x.select("crawl_id", "order", F.posexplode(links).alias("pos", "url")).select("crawl_id", "order", F.lit(step).alias("step"), "pos", "url", F.lit(kind).alias("kind"), none.alias("size"))
    nav = allow(sighted("nav_links", "nav", 0))
    feeds = sighted("feeds", "rss", 1)
    own = x.select("crawl_id", "order", F.lit(2).alias("step"), F.lit(0).alias("pos"), F.coalesce("metadata.canonical_url", "final_url").alias("url"), F.lit("content").alias("kind"), F.length("main_text").alias("size"))
    links = nav.unionByName(feeds).unionByName(own)
    if robots is not None:
        named = seeds.select("crawl_id", urls.origin(F.col("url")).alias("origin")).join(crawl.robots_sitemaps(robots), "origin")
        links = links.unionByName(named.select("crawl_id", F.lit(-1).cast("long").alias("order"), F.lit(0).alias("step"), "pos", "url", F.lit("sitemap").alias("kind"), none.alias("size")))
    ranked = crawl.walk_importance(links, ["crawl_id"], ["order", "step", "pos"])
    w = Window.partitionBy("crawl_id").orderBy(F.desc("score"), F.collate("url", "UNICODE"))
    important = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(limit, 10))
    flags = x.groupBy("crawl_id").agg(F.bool_or("login").alias("login_detected"), F.bool_or("search").alias("search_detected"), F.count(F.lit(1)).alias("pages_scanned"))
    return {"important": important.select("crawl_id", "rank", "url", "reason", "score"), "signals": flags, "navigation": nav.select("crawl_id", "url").distinct(), "feeds": feeds.select("crawl_id", "url").distinct()}


def crawl_sitemap_targets(sitemaps: DataFrame, pages: DataFrame, url_type: str | None = None, sort_by: str = "lastmod_desc", limit: int = 20) -> DataFrame:
    """Targets of each host's sitemaps joined to stored pages, one per canonical address."""
    e = sitemap.entries(sitemaps).withColumn("host", urls.host(F.col("url")))
    t = sitemap.targets(sitemap.merge_entries(e, ["host"], ["pos"]), ["host"], url_type, sort_by, limit)
    t = dedupe.checkpoint_table(t, "targets")
    wanted = t.select(F.col("url").alias("_u")).distinct()
    x = extracted(pages.join(wanted, urls.normalise(pages["url"]) == F.col("_u"), "left_semi")).withColumn("key", urls.normalise(F.col("url")))
    j = t.join(x.drop("url"), t["url"] == x["key"]).withColumn("canon", F.coalesce("metadata.canonical_url", "final_url"))
    return dedupe.keep_first(j, [F.col("host"), F.col("canon")], ["rank"]).select("host", "rank", F.col("final_url").alias("url"), "title", "main_text", "content_quality_score")


def find_leads(hits: DataFrame, pages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Leads from search hits: website, contacts, confidence, ranked.

    ``hits(position, title, url, snippet)``; candidate addresses are looked up in
    ``pages``.
    """
    q = contacts.interpret(query)
    text.bounded("limit", limit, 1, 1000)
    g = contacts.lead_groups(hits, q.location).orderBy(F.collate("name", "UNICODE"), "group_key").limit(2 * limit).drop("hit_urls")
    g = dedupe.checkpoint_table(g, "groups")
    wanted = contacts.resolution_query("", q.location, q.postal_code, q.category)
    c = g.select("group_key", "name", F.explode("candidate_urls").alias("url"))
    stored = snapshots(pages)
    pages = dedupe.checkpoint_table(pages.join(c.select("url").distinct(), "url", "left_semi").select("page_id", "url", "html"), "candidates")
    loc = scoring.array_literal([t for t in text.query_latin_tokens(q.location or "")])
    c = c.withColumn("heuristics", scoring.url_heuristics(F.col("url"), text.lead_tokens(F.col("name")), loc))
    x = extracted(pages)
    rel = scoring.relevance(wanted, F.col("title"), F.col("final_url"), F.col("headings")["text"], F.lit(None).cast("string"), F.col("metadata.meta_description"), F.col("main_text"))
    known = x.select(F.col("url").alias("url"), F.col("profile.trust_score").alias("trust"), rel.alias("relevance"), F.concat_ws(" ", "title", "metadata.og_title").alias("page_title"))
    c = c.join(known, "url", "left")
    score = scoring.website_score(F.col("trust"), F.col("relevance"), F.col("heuristics"), F.coalesce(scoring.name_hits(text.lead_tokens(F.col("name")), F.col("page_title")), F.lit(0)))
    best = dedupe.checkpoint_table(contacts.rank_websites(c.withColumn("score", score), ["group_key"]).withColumnRenamed("confidence", "website_confidence"), "websites")
    sites = best.select(F.col("best_website").alias("site"), F.col("best_website").alias("home"))
    pc = contacts.site_contacts(sites, stored).select("site", "contact_pages", F.col("confidence").alias("contact_confidence"), *contacts.FIELDS)
    j = g.join(best, "group_key").join(pc, F.col("best_website") == F.col("site"), "left")
    n = {k: F.coalesce(F.size(k), F.lit(0)) for k in contacts.FIELDS}
    j = j.withColumn("confidence", scoring.lead_confidence(F.col("website_confidence"), F.col("contact_confidence")))
    j = j.withColumn("rank_score", scoring.lead_rank(F.col("confidence"), F.col("best_website"), n["emails"], n["phones"], F.coalesce(F.size("contact_pages"), F.lit(0))))
    j = j.withColumn("location", F.lit(q.location).cast("string"))
    j = dedupe.keep_first(j, dedupe.lead_key(F.col("best_website"), F.col("name"), F.col("location")), ["first_position"])
    out = j.select(contacts.lead_id(F.col("best_website"), F.col("name"), F.col("location")).alias("lead_id"), "name", F.col("best_website").alias("website"), "confidence", "rank_score", "emails", "phones")
    return out.orderBy(F.desc("rank_score"), F.collate("name", "UNICODE")).limit(limit)


def url_chunks(pages: DataFrame, size: int = 1200, overlap: int = 150, max_chunks: int = 20, strategy: str = "heading") -> DataFrame:
    """Chunks of each page by heading sections or fixed windows."""
    if strategy == "fixed":
        x = extract(snapshots(pages), ("title", "main_text"))
        return fixed_chunks(x.select("page_id", "main_text"), "main_text", size, overlap, max_chunks)
    return section_chunks(extract(snapshots(pages), ("sections", "main_text")).select("page_id", "sections"), ["page_id"], "sections", size, overlap, max_chunks)


def plain_html(pages: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """Title and whole text of each page, without scripts, styles and what shows in their stead."""
    x = extract(snapshots(pages), ("title", "body_text"))
    cut, more = text.truncate(F.col("body_text"), max_chars)
    return x.select("page_id", "title", cut.alias("text"), more.alias("text_truncated"))


def markdown(pages: DataFrame, max_chars: int = 12_000, with_links: bool = True) -> DataFrame:
    """Pages as Markdown with title, metadata and quality."""
    x = page_quality(extract(snapshots(pages), (*MAIN, "markdown"), with_links=with_links))
    cut, more = text.truncate(F.col("markdown"), max_chars)
    return x.select("page_id", "url", "title", cut.alias("markdown"), more.alias("markdown_truncated"), "metadata", "content_hash", "content_quality_score")
