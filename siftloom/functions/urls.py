"""URL functions as Column expressions.

URLs are taken apart by one pattern instead of a Java URI parser, which rejects
many addresses that browsers accept.  Where a URL doesn't fit, parts are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\[]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Hosts and path words of the classifications.
MEDIA = r"(^|\.)reuters\.com$|(^|\.)apnews\.com$|(^|\.)bbc\.|(^|\.)nytimes\.com$|(^|\.)theguardian\.com$|(^|\.)wsj\.com$|(^|\.)ft\.com$|(^|\.)bloomberg\.com$"
SCIENCE = r"\.edu($|\.)|\.ac\.[a-z.]+$|(^|\.)arxiv\.org$|(^|\.)pubmed\.ncbi\.nlm\.nih\.gov$|(^|\.)doi\.org$|(^|\.)nature\.com$|(^|\.)springer\.com$|(^|\.)sciencedirect\.com$|(^|\.)ieee\.org$|(^|\.)acm\.org$"
GOVERNMENT = r"\.gov($|\.)|\.gouv\.|\.gv\."
COMMUNITY_HOST = r"(^|\.)reddit\.com$|(^|\.)stackoverflow\.com$|(^|\.)stackexchange\.com$|(^|\.)medium\.com$|(^|\.)dev\.to$|(^|\.)discourse\.|(^|\.)forum\."
COMMUNITY_PATH = r"/(forum|community|discussion|questions?|threads?)/"
OFFICIAL_HOST = r"^(docs|developer|developers|support|help|api)\."
OFFICIAL_PATH = r"/(docs|guide|reference|manual|api|developers?)(/|$)"
SEGMENT_TYPES = {
    "docs": "docs?|guide|manual|api|kb|knowledge-base|learn|release-notes?|releases?|changelog|change-log",
    "blog": "blog|news|articles?|posts?",
    "product": "product|products|pricing|item|shop",
    "category": "category|categories|catalog|collections?|tags?",
    "policy": "privacy|terms|legal|policy|policies|imprint|impressum",
}
SUBSTRING_TYPES = {
    "policy": "privacy|policy|terms|legal|cookie|cookies|compliance|gdpr|security|trust|acceptable-use|aup|imprint|impressum",
    "docs": "docs|guide|manual|reference|api|help|faq|support|knowledge|kb|learn|tutorial|how-to|documentation",
    "blog": "blog|news|article|post|press|release|update|updates|changelog|journal|stories|insights",
    "product": "product|products|shop|store|item|items|sku|pricing|price|offer|offers|catalog|catalogue",
    "category": "category|categories|tag|tags|collection|collections|topic|topics|brand|brands|archive|archives",
}
DIRECTORIES = "gelbeseiten|11880|dasoertliche|branchenbuch|telefonbuch|cylex|yelp|meinestadt|werkenntdenbesten|golocal"
STRUCTURE_WORDS = "docs|guide|manual|reference|api|article|blog|post|tutorial|learn"
INDEX_PATH = r"/(tag|tags|search|results|archive|archives|category|categories|feed|print)(/|$)"
CONTACT_PAGES = {
    "impressum": "impressum|imprint|legal",
    "kontakt": "kontakt|contact|ansprechpartner|anfahrt",
    "about": "ueber-uns|über-uns|about|company|unternehmen",
    "team": "team|staff|people",
}
IMPORTANT = {"rss": "feed|rss|atom", "sitemap": "sitemap", "nav": "docs|guide|about|blog|search|login|account"}


def _part(url: Column, n: int) -> Column:
    """Part ``n`` of a URL; all parts share one pattern match and one split, which code generation evaluates once."""
    marked = F.regexp_replace(url, PATTERN, "\u0001$1\u0001$2\u0001$3\u0001$4\u0001$5")
    return F.get(F.split(marked, "\u0001"), F.lit(n))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def port(url: Column) -> Column:
    """The port, empty where it is the scheme's own."""
    p = _part(url, 3)
    own = ((scheme(url) == "http") & (p == "80")) | ((scheme(url) == "https") & (p == "443"))
    return F.when(own, "").otherwise(p)


def path(url: Column) -> Column:
    p = _part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """The query with its question mark; a bare one stays."""
    return _part(url, 5)


def authority(url: Column) -> Column:
    p = port(url)
    return F.concat(host(url), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def without_params(q: Column, names: list[str]) -> Column:
    """A query string without the named parameters."""
    if not names:
        return q
    kept = F.filter(F.split(F.regexp_replace(q, r"^\?", ""), "&"), lambda kv: ~F.split_part(kv, F.lit("="), F.lit(1)).isin(*names))
    return F.when((q == "") | (F.size(kept) == 0), "").otherwise(F.concat(F.lit("?"), F.array_join(kept, "&")))


def normalise(url: Column, drop: list[str] | None = None) -> Column:
    """Without fragment, host in lower case, default port and the named parameters."""
    return F.concat(origin(url), path(url), without_params(query(url), drop or []))


def stripped_params(url: Column, names: list[str]) -> Column:
    """Which of the named parameters the URL has, in order of the list."""
    have = F.transform(F.split(F.regexp_replace(query(url), r"^\?", ""), "&"), lambda kv: F.split_part(kv, F.lit("="), F.lit(1)))
    return F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.array_contains(have, n))


def result_key(url: Column) -> Column:
    """Identity of a search hit: no ``www.``, closing slashes or fragment; other text in lower case as it is."""
    bare = F.regexp_replace(path(url), "/+$", "")
    q = F.regexp_replace(query(url), r"^\?$", "")
    return F.coalesce(F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), F.when(bare == "", "/").otherwise(bare), q), F.lower(url))


def _chain(subject: Column, kinds: dict[str, str], wrap: str = "({})", other: str = "other") -> Column:
    out = None
    for kind, words in kinds.items():
        test = subject.rlike(wrap.format(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(other)


def segment_type(url: Column) -> Column:
    """Type by whole path segments."""
    return _chain(F.lower(url), SEGMENT_TYPES, "(^|/)({})(/|$)")


def substring_type(url: Column) -> Column:
    """Type by words anywhere in host and path."""
    return _chain(F.concat_ws(" ", F.coalesce(host(url), F.lit("")), F.lower(F.coalesce(path(url), F.lit("")))), SUBSTRING_TYPES)


def source_type(url: Column) -> Column:
    """government, scientific, major_media, community, official or unknown."""
    h, p = host(url), F.lower(path(url))
    return (
        F.when(h.isNull(), "unknown")
        .when(h.rlike(GOVERNMENT), "government")
        .when(h.rlike(SCIENCE), "scientific")
        .when(h.rlike(MEDIA), "major_media")
        .when(h.rlike(COMMUNITY_HOST) | p.rlike(COMMUNITY_PATH), "community")
        .when(h.rlike(OFFICIAL_HOST) | p.rlike(OFFICIAL_PATH), "official")
        .otherwise("unknown")
    )


def is_directory(url: Column) -> Column:
    return F.lower(url).rlike(DIRECTORIES)


def important_reason(url: Column) -> Column:
    return _chain(F.lower(url), IMPORTANT, other="content")


def contact_page_type(url: Column, title: Column, text: Column) -> Column:
    """By words in decoded address, title and text."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return _chain(F.lower(F.concat_ws(" ", decoded, F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))), CONTACT_PAGES)


def extension(url: Column) -> Column:
    """Suffix of the last path segment with its dot, in lower case, or null."""
    last = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    ext = F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))
    return F.when(ext != "", ext)


def is_pdf(url: Column) -> Column:
    return F.lower(url).rlike(r"\.pdf($|[?#])")


def disposition_filename(header: Column) -> Column:
    """File name of a content-disposition header: the encoded form first."""
    star = F.trim(F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1))
    star = F.regexp_replace(star, '^"|"$', "")
    plain = F.trim(F.regexp_extract(header, r"(?i)filename\s*=\s*\"?([^\";]+)", 1))
    return F.when(star != "", F.coalesce(F.try_url_decode(F.replace(star, F.lit("+"), F.lit("%2B"))), star)).when(plain != "", plain)


def structure_bonus(url: Column) -> Column:
    """Points for telling paths, shallow ones and https; null for no URL."""
    p = F.lower(path(url))
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    points = F.when(p.rlike(STRUCTURE_WORDS), 12).otherwise(0) + F.when(depth <= 3, 4).otherwise(0) + F.when(scheme(url) == "https", 4).otherwise(0)
    return F.when(p.isNotNull(), F.least(F.lit(20), points))


def path_tokens(url: Column) -> Column:
    return tokens(F.when(host(url).isNotNull(), F.concat(host(url), F.lit(" "), path(url))).otherwise(url))


def prefers_rendering(url: Column, snippet: Column) -> Column:
    """Short snippets and addresses that look like applications."""
    return (F.length(F.trim(snippet)) < 80) | F.lower(url).rlike("app|dashboard|interactive|viewer|spa|search|results")


def glob(pattern: str, whole: bool) -> str:
    """A glob as a case-insensitive pattern: ``*`` any run, ``?`` one character; ``whole``: must match all.

    A pattern over parts of a URL that ends in ``$`` was never valid and is a plain substring test.
    """
    if not whole and pattern.endswith("$"):
        return "(?is)" + "".join("\\" + c if not c.isalnum() else c for c in pattern)
    body = "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if c in r"\^$.+()[]{}|" else c) for c in pattern)
    return f"(?i)^{body}$" if whole else f"(?i){body}"


def _first_match(value: Column, patterns: list[str], whole: bool) -> Column:
    return F.coalesce(*[F.when(value.rlike(glob(p, whole)), p) for p in patterns], F.lit(None).cast("string"))


def decide(url: Column, include: list[str] = (), exclude: list[str] = (), exclude_paths: list[str] = (), exclude_params: list[str] = (), start_url: str | None = None, same_domain: bool = False) -> Column:
    """Whether a URL may be followed: struct of allowed, reason, matched_pattern and normalized_url."""
    norm = normalise(url, list(exclude_params))
    by_path = _first_match(path(url), list(exclude_paths), True)
    by_url = _first_match(norm, list(exclude), False)
    within = _first_match(norm, list(include), False)
    away = (origin(url) != origin(F.lit(start_url))) if same_domain and start_url else F.lit(False)
    reason = F.when(away, "same_domain_only").when(by_path.isNotNull(), "exclude_path").when(by_url.isNotNull(), "exclude_pattern")
    matched = F.when(away, F.lit(None).cast("string")).when(by_path.isNotNull(), by_path).when(by_url.isNotNull(), by_url)
    if include:
        reason = reason.when(within.isNull(), "include_pattern").otherwise("included")
        matched = matched.otherwise(within)
    allowed = F.coalesce(reason.isNull() | (reason == "included"), F.lit(False))
    return F.struct(allowed.alias("allowed"), reason.alias("reason"), matched.alias("matched_pattern"), norm.alias("normalized_url"))


_V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


#: This network, private, loopback, shared, link-local, benchmark, multicast and reserved blocks.
_PRIVATE_V4 = r"^(0|10|127)\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^198\.1[89]\.|^(22[4-9]|2[3-9][0-9])\."
_PRIVATE_V6 = r"^(::|::1)$|^(fc|fd|fe8|fe9|fea|feb|ff)"


def private_ip(ip: Column) -> Column:
    """Loopback, private, link-local, shared, benchmark and multicast addresses; true for what is no address."""
    bare = F.lower(F.regexp_replace(ip, r"^\[(.*)\]$", "$1"))
    private6 = bare.rlike(_PRIVATE_V6) | F.regexp_replace(bare, "^::ffff:", "").rlike(_PRIVATE_V4)
    return F.coalesce(F.when(bare.rlike(_V4), bare.rlike(_PRIVATE_V4)).when(bare.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), private6).otherwise(True), F.lit(True))


def blocked_reason(url: Column) -> Column:
    """Why an address may not be fetched, or null: no URL, other schemes, credentials, localhost, private literal addresses."""
    h = F.regexp_replace(host(url), r"^\[(.*)\]$", "$1")
    literal = h.rlike(_V4) | h.contains(":")
    return (
        F.when(host(url).isNull(), "invalid url")
        .when(~scheme(url).isin("http", "https"), "unsupported protocol")
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"), "credentials")
        .when(h == "localhost", "localhost")
        .when(literal & private_ip(h), "private network")
    )
