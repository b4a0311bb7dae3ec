"""Sitemaps: parsing by pattern, index expansion, entries, groups, targets.

Addresses are found by pattern, which also reads documents that are cut off.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .dedupe import checkpoint_table

_TAG = r"(?is)<(?:[\w.-]+:)?{0}\b"


def kind(xml: Column) -> Column:
    return F.when(xml.rlike(_TAG.format("sitemapindex")), "index").when(xml.rlike(_TAG.format("urlset")), "urlset").otherwise("unknown")


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _field(block: Column, name: str) -> Column:
    v = _unescape(F.trim(F.regexp_extract(block, rf"(?is)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)))
    return F.when(v != "", v)


def entries(sitemaps: DataFrame) -> DataFrame:
    """Entries of urlsets: the other columns, pos, url, lastmod, changefreq, priority.

    Only absolute http(s) addresses count; their fragments go.  Where no
    ``<url>`` block is whole, bare ``<loc>`` elements are taken.
    """
    rest = [c for c in sitemaps.columns if c != "xml"]
    s = sitemaps.where(kind(F.col("xml")) == "urlset")
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)(<loc>.*?</loc>)"), F.lit(1))
    e = s.select(*rest, F.posexplode(F.when(F.size(blocks) > 0, blocks).otherwise(locs)).alias("pos", "b"))
    e = e.where(_field(F.col("b"), "loc").rlike("(?i)^https?://"))
    e = e.select(*rest, "pos", urls.normalise(_field(F.col("b"), "loc")).alias("url"), _field(F.col("b"), "lastmod").alias("lastmod"), _field(F.col("b"), "changefreq").alias("changefreq"), _field(F.col("b"), "priority").try_cast("double").alias("priority"))
    return e


def children(sitemaps: DataFrame) -> DataFrame:
    """Nested sitemaps of indexes: the other columns, pos, child."""
    rest = [c for c in sitemaps.columns if c != "xml"]
    s = sitemaps.where(kind(F.col("xml")) == "index")
    c = s.select(*rest, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))).alias("pos", "l"))
    return c.where(F.trim("l").rlike("(?i)^https?://")).select(*rest, "pos", urls.normalise(_unescape(F.trim("l"))).alias("child"))


def expand(sitemaps: DataFrame, roots: DataFrame, max_depth: int = 5, max_sitemaps: int = 20, same_host: bool = True) -> DataFrame:
    """Sitemaps reached from each root: root, url, depth, order.

    ``sitemaps(url, xml)``; ``roots(root)``.  Breadth first, each address once,
    in order of depth and place, ``max_sitemaps`` of a root at most (its feature).
    """
    links = children(sitemaps).select(F.col("url").alias("parent"), "child", "pos")
    level = roots.select("root", F.col("root").alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("order"))
    found = level = checkpoint_table(level, "sitemaps")
    for depth in range(1, max_depth + 1):
        nxt = level.join(links, level["url"] == links["parent"]).select("root", F.col("child").alias("url"), "order", "pos")
        if same_host:
            nxt = nxt.where(urls.host(F.col("url")) == urls.host(F.col("root")))
        nxt = nxt.groupBy("root", "url").agg(F.min(F.struct("order", "pos")).alias("o")).join(found.select("root", "url"), ["root", "url"], "left_anti")
        w = Window.partitionBy("root").orderBy("o")
        # later levels can't get in once a tree is full
        full = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_sitemaps).select("root")
        nxt = nxt.join(full, "root", "left_anti")
        level = checkpoint_table(nxt.select("root", "url", F.lit(depth).alias("depth"), (F.lit(depth) * F.lit(1 << 40) + F.row_number().over(w)).alias("order")), "sitemaps")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    w = Window.partitionBy("root").orderBy("order")
    n = F.row_number().over(w)
    return found.withColumn("n", n).where(F.col("n") <= max_sitemaps).select("root", "url", "depth", (F.col("n") - 1).alias("order"))


#: Words of a query, anywhere in it, and the type of sitemap targets that they ask for; the first that fits.
QUERY_TYPES = [
    ("docs", "api|docs|guide|install|reference|manual|how to|tutorial|release notes|release|changelog|change log"),
    ("policy", "privacy|policy|terms|legal|impressum|gdpr|cookie"),
    ("blog", "announcement|news|blog"),
    ("product", "price|pricing|feature|product|plan|sku|offer"),
]


def type_of_query(query: str) -> str | None:
    """The type of sitemap targets that a query asks for."""
    return next((kind for kind, words in QUERY_TYPES if re.search(words, query.lower())), None)


def merge_entries(found: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per address with the first known value of each field, and its inferred type."""
    o = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c)
    m = found.groupBy(*by, "url").agg(first("lastmod"), first("changefreq"), first("priority"))
    return m.withColumn("inferred_type", urls.substring_type(F.col("url")))


def groups(merged: DataFrame, by: list[str], sample: int = 3) -> DataFrame:
    """Entries by type: label, count, first addresses."""
    w = Window.partitionBy(*by, "inferred_type").orderBy(F.collate("url", "UNICODE"))
    r = merged.withColumn("_n", F.row_number().over(w))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= sample, F.struct("_n", "url"))))
    return r.groupBy(*by, F.col("inferred_type").alias("label")).agg(F.count(F.lit(1)).alias("count"), F.transform(kept, lambda x: x["url"]).alias("sample_urls"))


def targets(merged: DataFrame, by: list[str], url_type: str | None = None, sort_by: str = "lastmod_desc", limit: int = 20, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Entries to crawl, best first, with their rank."""
    t = merged.where(F.col("inferred_type") == url_type) if url_type else merged
    if include or exclude:
        t = t.where(urls.decide(F.col("url"), list(include), list(exclude))["allowed"])
    when = F.coalesce(F.unix_millis(F.col("lastmod").try_cast("timestamp")), F.lit(0))
    path = urls.path(F.col("url"))
    order = {"lastmod_desc": [when.desc(), F.collate("url", "UNICODE")], "lastmod_asc": [when.asc(), F.collate("url", "UNICODE")], "path": [F.collate(path, "UNICODE")]}[sort_by]
    w = Window.partitionBy(*by).orderBy(*order, "url")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
