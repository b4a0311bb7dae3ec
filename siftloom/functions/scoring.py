"""Scores as Column expressions: relevance, extraction quality, trust, contacts, leads, claims.

Queries are parameters: their tokens are worked out once and enter the plan as
literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import EDGE, clamp, coverage, query_tokens, round0, round2, squeeze, squeeze_text, tokens, words_of

#: Base trust of each source type.
BASE_TRUST = {"government": 92, "scientific": 88, "official": 82, "major_media": 72, "community": 42}
KIND_BONUS = {"chunks": 18, "markdown": 14, "text": 8}
METADATA = ["canonical_url", "meta_description", "lang", "author", "published_at", "modified_at", "og_title", "og_description"]


def phrase_bonus(query: str, value: Column) -> Column:
    """15 for the whole query, 8 if all of several tokens occur."""
    q = squeeze_text(query).lower()
    v = F.lower(squeeze(value))
    need = query_tokens(query)
    if not q:
        return F.lit(0)
    out = F.when(v.contains(q), 15)
    if len(need) > 1:
        every = F.lit(True)
        for t in need:
            every = every & v.contains(t)
        out = out.when(every, 8)
    return out.otherwise(0)


def search_score(query: str, title: Column, url: Column, snippet: Column, position: Column | int = 0) -> Column:
    """How well a hit fits a query: struct of the parts and ``total`` (0 to 100, two decimals)."""
    need = query_tokens(query)
    t, s, u = coverage(need, tokens(title)), coverage(need, tokens(snippet)), coverage(need, urls.path_tokens(url))
    cover = t * 0.5 + s * 0.35 + u * 0.15
    structure = urls.structure_bonus(url) + phrase_bonus(query, F.concat_ws(" ", title, snippet))
    pos = F.lit(position) if isinstance(position, int) else position
    penalty = F.least(F.lit(18), F.greatest(F.lit(0), pos) * 3)
    total = clamp(cover * 0.45 + t * 0.28 + s * 0.14 + u * 0.08 + structure - penalty)
    d = lambda c: round2(c.cast("double"))
    return F.struct(d(cover).alias("query_coverage"), d(t).alias("title_match"), d(s).alias("snippet_match"), d(u).alias("url_match"), d(structure).alias("structure_bonus"), d(penalty).alias("position_penalty"), d(total).alias("total"))


def result_score(query: str, title: Column, url: Column, snippet: Column, language: str | None = None) -> Column:
    """Score of a hit without its position, with bonuses for language and page type."""
    total = search_score(query, title, url, snippet)["total"]
    low, lang = F.lower(url), (language or "").lower()
    if lang.startswith("de"):
        total = total + F.when(low.rlike(r"\.de(/|$)|/de(/|$)"), 6).otherwise(0)
    elif lang.startswith("en"):
        total = total + F.when(low.rlike(r"/en(/|$)"), 6).otherwise(0)
    kind = urls.segment_type(url)
    total = total + F.when(kind == "docs", 8).when(kind == "blog", 4).when(kind.isin("category", "policy"), -6).otherwise(0)
    return round2(clamp(total))


def relevance(query: str, title: Column, url: Column, headings: Column, snippet: Column, description: Column, text: Column) -> Column:
    """Whole-number relevance of a page: title and headings against snippet, description and text."""
    none = F.lit("")
    head = F.trim(F.concat_ws(" ", F.coalesce(title, none), F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " ")))
    body = F.trim(F.concat_ws(" ", F.coalesce(snippet, none), F.coalesce(description, none), F.coalesce(text, none)))
    return round0(search_score(query, head, url, body)["total"])


def extraction_score(kind: str, text: Column, n_headings: Column, n_links: Column, n_chunks: Column | int, n_metadata: Column, truncated: Column) -> Column:
    """Quality of an extraction: struct of the parts and ``total``."""
    chunks = F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks
    length = F.least(F.lit(30.0), F.length(squeeze(F.coalesce(text, F.lit("")))) / 80.0)
    heads, links, pieces = F.least(F.lit(12.0), n_headings * 2.5), F.least(F.lit(8.0), n_links * 0.8), F.least(F.lit(10.0), chunks * 1.5)
    structure = heads + links + pieces
    meta = F.least(F.lit(20.0), n_metadata * 2.5)
    cut = F.when(truncated, 18.0).otherwise(0.0)
    bonus = F.lit(float(KIND_BONUS[kind]))
    total = clamp(bonus + length + heads + links + pieces + meta - cut)
    return F.struct(bonus.alias("kind_bonus"), round2(length).alias("length_score"), round2(structure).alias("structure_score"), round2(meta).alias("metadata_score"), cut.alias("truncation_penalty"), round2(total).alias("total"))


def metadata_fields(meta: Column) -> Column:
    """How many of the eight metadata fields are filled."""
    return sum((F.when(F.coalesce(meta[k], F.lit("")) != "", 1).otherwise(0) for k in METADATA), F.lit(0))


def content_quality(text: Column, n_headings: Column, n_links: Column, n_metadata: Column, truncated: Column) -> Column:
    """Whole-number quality of extracted main text (rounded from two decimals)."""
    return round0(extraction_score("markdown", text, n_headings, n_links, 0, n_metadata, truncated)["total"])


def word_count(text: Column) -> Column:
    """Distinct tokens of a text."""
    return F.size(tokens(text))


def combined(search: Column, extraction: Column) -> Column:
    return round2(clamp(search * 0.6 + extraction * 0.4))


def extraction_kind(title: Column, url: Column, snippet: Column, preferred: str = "auto", max_chars: int = 0) -> Column:
    """Which form of extraction suits a hit."""
    if preferred != "auto":
        return F.lit(preferred)
    hay = F.lower(F.concat_ws(" ", title, snippet, url))
    long = F.lit(max_chars >= 12000)
    return (
        F.when(hay.rlike("/(login|signin|sign-in|account|search|about|help|faq)" + EDGE), "markdown")
        .when(hay.rlike("docs|guide|manual|reference|api|tutorial|article|blog|post|chapter|learn"), F.when(long | (F.length(snippet) > 180), "chunks").otherwise("markdown"))
        .when(long | (F.length(snippet) > 220), "chunks")
        .otherwise("markdown")
    )


def source_profile(url: Column, canonical: Column, author: Column, published: Column, quality: Column, words: Column, ratio: Column) -> Column:
    """Trust in a source: struct of source_type, trust_score, signals and notes.

    Missing quality and words count as 0; a missing boilerplate ratio gives
    neither bonus nor penalty.
    """
    kind = urls.source_type(url)
    base = None
    for k, v in BASE_TRUST.items():
        base = F.when(kind == k, v) if base is None else base.when(kind == k, v)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    q, w = F.coalesce(quality, F.lit(0)), F.coalesce(words, F.lit(0))
    steps = [
        [(urls.scheme(url) == "https", 2, "uses https")],
        [(has(canonical), 4, "has canonical url")],
        [(has(author), 4, "has author metadata")],
        [(has(published), 6, "has publication date")],
        [(w > 250, 4, "has substantial text"), ((w > 0) & (w < 50), -10, "very short content")],
        [(q >= 80, 6, "high content quality"), (q >= 60, 3, "good content quality"), ((q > 0) & (q < 35), -8, "thin or noisy content")],
        [(ratio >= 0.45, -10, "high boilerplate ratio"), (ratio <= 0.15, 4, "low boilerplate ratio")],
        [(F.lower(urls.path(url)).rlike(urls.INDEX_PATH), -12, "looks like an index or low-value utility page")],
    ]
    score, notes = base.otherwise(55), []
    for group in steps:
        points, note = None, None
        for test, p, text in group:
            points = F.when(test, p) if points is None else points.when(test, p)
            note = F.when(test, text) if note is None else note.when(test, text)
        score = score + points.otherwise(0)
        notes.append(note)
    notes.append(F.when(kind == "community", "community source should be cross-checked").when(kind == "unknown", "source type is not strongly classifiable").otherwise(F.concat(F.lit("classified as "), kind)))
    signals = F.struct((kind == "official").alias("official_domain"), (kind == "government").alias("government_domain"), (kind == "scientific").alias("scientific_domain"), has(author).alias("has_author"), has(published).alias("has_published_at"), has(canonical).alias("has_canonical"), ratio.alias("boilerplate_ratio"))
    return F.struct(kind.alias("source_type"), clamp(score).cast("int").alias("trust_score"), signals.alias("signals"), F.filter(F.array(*notes), lambda n: n.isNotNull()).alias("notes"))


def url_heuristics(url: Column, name_tokens: Column, location_tokens: Column) -> Column:
    """Points of an address as the website of a business; tokens may repeat, each counts."""
    p = F.lower(urls.path(url))
    p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    hay = F.concat_ws(" ", urls.host(url), p)
    found = lambda ts: F.size(F.filter(ts, lambda t: F.contains(hay, t)))
    shallow = F.size(F.filter(F.split(p, "/"), lambda s: s != "")) <= 1
    return found(name_tokens) * 6 + found(location_tokens) * 3 + F.when(urls.scheme(url) == "https", 2).otherwise(0) + F.when(shallow, 6).otherwise(0) + F.when(hay.rlike(urls.DIRECTORIES), -40).otherwise(0)


def website_score(trust: Column, relevance_: Column, heuristics: Column, title_hits: Column) -> Column:
    """Total of a website candidate; without a page (null trust) the heuristics alone, plus 10."""
    return F.when(trust.isNull(), clamp(heuristics + 10).cast("double")).otherwise(clamp(trust + relevance_ / 2.0 + heuristics + title_hits * 6))


def contact_confidence(has_website: Column, impressum: Column, n_emails: Column, n_phones: Column, n_addresses: Column, n_people: Column, n_pages: Column) -> Column:
    some = lambda n, p: F.when(n > 0, p).otherwise(0)
    return clamp(F.when(has_website, 35).otherwise(15) + F.when(impressum, 30).otherwise(0) + some(n_emails, 15) + some(n_phones, 10) + some(n_addresses, 10) + some(n_people, 5) + F.least(F.lit(10), n_pages * 2)).cast("int")


def lead_rank(confidence: Column, website: Column, n_emails: Column, n_phones: Column, n_pages: Column) -> Column:
    return confidence + F.when(website.isNotNull(), 10).otherwise(0) + F.when(n_emails > 0, 10).otherwise(0) + F.when(n_phones > 0, 8).otherwise(0) + F.when(n_pages > 0, 4).otherwise(0)


def lead_confidence(website: Column, contacts: Column) -> Column:
    """Mean of both where there are contacts, else the website's."""
    return F.when(contacts.isNull(), website).otherwise(round0((website + contacts) / 2.0))


def claim_confidence(n_support: Column, avg_trust: Column) -> Column:
    return F.when((n_support >= 2) & (avg_trust >= 75), "high").when((n_support >= 1) & (avg_trust >= 60), "medium").otherwise("low")


def research_summary(n_claims: Column, well: Column, conflicting: Column, institutional: Column) -> Column:
    """struct of answered, confidence and gaps."""
    gaps = F.array(
        F.when(n_claims == 0, "No well-supported claim could be extracted from the available sources."),
        F.when(conflicting > 0, "Some claims have conflicting evidence and should be checked manually."),
        F.when(~institutional, "No strong primary or institutional source was found in the source set."),
    )
    return F.struct((n_claims > 0).alias("answered"), F.when(well > 0, "high").when(n_claims > 0, "medium").otherwise("low").alias("confidence"), F.filter(gaps, lambda g: g.isNotNull()).alias("gaps"))


def name_hits(names: Column, text: Column) -> Column:
    """How many tokens occur anywhere in a text."""
    low = F.lower(text)
    return F.size(F.filter(names, lambda t: F.contains(low, t)))


def array_literal(values: list[str]) -> Column:
    return words_of(*values) if values else F.array().cast("array<string>")
