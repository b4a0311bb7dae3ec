"""Search hits: intent, variants, merging, ranking, corpus search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, urls
from ..functions.text import query_tokens, squeeze_text
from .dedupe import keep_first

#: Topics that are also searched for in English.
ENGLISH_TOPICS = ["target audience", "market position", "competitors", "alternatives", "pricing", "features"]


@dataclass(frozen=True)
class Intent:
    """What a query asks for, with the variants to try."""

    original: str
    domain: str | None
    brand: str | None
    topic: str | None
    variants: tuple[str, ...]
    languages: tuple[str, ...]


def intent(query: str, language: str = "de") -> Intent:
    q = squeeze_text(query)
    m = re.search(r"(?a:\b)(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?a:\b)", q, re.I | re.A)
    domain = m[1].lower() if m else None
    brand = next((x for x in domain.split(".") if x), None) if domain else None
    topic = q
    if domain:
        topic = squeeze_text(re.sub(rf"\b(?:https?://)?(?:www\.)?{re.escape(domain)}\b", "", q, flags=re.I | re.A))
    topic = topic or None
    tries = [q]
    if domain:
        tail = f" {topic}" if topic else ""
        tries += [f"site:{domain}{tail}", f'"{domain}"{tail}']
        if brand:
            tries += [f'"{brand}"{tail}', f"{brand}{tail}"] if topic else [brand]
    langs = [language] + (["en"] if topic and any(t in topic.lower() for t in ENGLISH_TOPICS) else [])
    unique = lambda xs, n: tuple(list(dict.fromkeys(x for x in xs if x))[:n])
    return Intent(q, domain, brand, topic, unique(tries, 6), unique(langs, 2))


def parse_hits(payloads: DataFrame, body_col: str = "body", limit: int = 10) -> DataFrame:
    """Rows of search service payloads: other columns, position, title, url, snippet.

    Hits need a title and an address; snippets are cut to 500 characters.
    """
    schema = "results array<struct<title:string,url:string,content:string>>"
    rest = [c for c in payloads.columns if c != body_col]
    hits = payloads.select(*rest, F.posexplode(F.from_json(body_col, schema)["results"]).alias("position", "r"))
    hits = hits.where("r.title <> '' and r.url <> ''")
    return hits.where(F.col("position") < limit).select(*rest, "position", "r.title", "r.url", F.substring(F.trim(F.coalesce("r.content", F.lit(""))), 1, 500).alias("snippet"))


def merge_hits(hits: DataFrame, limit: int, group: list[str] | None = None) -> DataFrame:
    """First of each address over attempts in order (``variant``, ``position``), at most ``limit`` per group."""
    from pyspark.sql import Window

    g = group or []
    first = keep_first(hits, [*[F.col(c) for c in g], urls.result_key(F.col("url"))], ["variant", "position"])
    w = Window.partitionBy(*g).orderBy("variant", "position")
    if not g:
        return first.orderBy("variant", "position").limit(limit)
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def domain_hits(extracted: DataFrame, domain: str) -> DataFrame:
    """A hit for a domain's start page, for queries without others: title (else the domain), address, description or text.

    ``extracted``: url, title, metadata, main_text.
    """
    home = extracted.where((urls.host(F.col("url")) == domain.lower()) & (urls.path(F.col("url")) == "/"))
    snippet = F.substring(F.trim(F.coalesce(F.nullif(F.col("metadata.meta_description"), F.lit("")), "main_text", F.lit(""))), 1, 500)
    hits = home.select(F.lit(0).alias("variant"), F.lit(0).alias("position"), F.coalesce("title", F.lit(domain)).alias("title"), "url", snippet.alias("snippet"), F.col("title").isNotNull().alias("_t"))
    return hits.where(F.col("_t") | (F.col("snippet") != "")).drop("_t")


def with_fallback(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """``hits``, or ``fallback`` where there is none."""
    none = hits.limit(1).agg(F.count(F.lit(1)).alias("_some"))
    return hits.unionByName(fallback.crossJoin(F.broadcast(none)).where("_some = 0").drop("_some"))


def search_corpus(pages: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Local stand-in for a search service: pages (title, url, snippet, and body where present) that share a token with the query, best first."""
    need = query_tokens(query)
    from ..functions.text import tokens

    hay = tokens(F.concat_ws(" ", "title", "body" if "body" in pages.columns else "snippet", "url"))
    hits = pages.where(F.arrays_overlap(hay, scoring.array_literal(need)))
    score = scoring.search_score(query, F.col("title"), F.col("url"), F.col("snippet"))["total"]
    return hits.withColumn("quality_score", score).orderBy(F.desc("quality_score"), F.collate("url", "UNICODE")).limit(limit)


def rerank(hits: DataFrame, query: str, language: str | None = None, limit: int | None = None) -> DataFrame:
    """By score without position, then address."""
    out = hits.withColumn("quality_score", scoring.result_score(query, F.col("title"), F.col("url"), F.col("snippet"), language)).orderBy(F.desc("quality_score"), F.collate("url", "UNICODE"))
    return out.limit(limit) if limit else out


def rerank_with_position(hits: DataFrame, query: str) -> DataFrame:
    """By score with a penalty for late positions, then position, then address."""
    s = scoring.search_score(query, F.col("title"), F.col("url"), F.col("snippet"), F.col("position"))
    return hits.withColumn("quality_score", s["total"]).orderBy(F.desc("quality_score"), "position", F.collate("url", "UNICODE"))
