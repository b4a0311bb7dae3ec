"""Crawls over stored pages: breadth-first walks of a link table, level by level.

Several crawls run at once; each level is a few joins, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .dedupe import checkpoint_table


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 10, dead_ends: DataFrame | None = None) -> DataFrame:
    """Pages of each crawl in order: crawl_id, url, depth, order.

    ``edges(src_url, dst_url, pos)``, ``seeds(crawl_id, url)``.  A page is queued
    once, by its first parent and place; pages of ``dead_ends(crawl_id, url)``
    (duplicates) are counted but not followed.  ``max_pages`` cuts the order.
    """
    level = seeds.select("crawl_id", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("order"))
    seen = level = checkpoint_table(level, "frontier")
    for depth in range(1, max_depth + 1):
        source = level if dead_ends is None else level.join(dead_ends, ["crawl_id", "url"], "left_anti")
        nxt = source.select("crawl_id", F.col("url").alias("src_url"), "order").join(edges, "src_url")
        nxt = nxt.groupBy("crawl_id", F.col("dst_url").alias("url")).agg(F.min(F.struct("order", "pos")).alias("o"))
        nxt = nxt.join(seen.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
        w = Window.partitionBy("crawl_id").orderBy("o", "url")
        level = nxt.select("crawl_id", "url", F.lit(depth).alias("depth"), (F.lit(depth).cast("long") * F.lit(1 << 40) + F.row_number().over(w)).alias("order"))
        # later levels can't get in once a crawl is full
        full = seen.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_pages).select("crawl_id")
        level = checkpoint_table(level.join(full, "crawl_id", "left_anti"), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    n = F.row_number().over(Window.partitionBy("crawl_id").orderBy("order"))
    return seen.withColumn("n", n).where(F.col("n") <= max_pages).select("crawl_id", "url", "depth", (F.col("n") - 1).alias("order"))


def link_importance(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Importance of links of each group: the columns ``by``, url, reason, score.

    ``links(url, kind, size)`` with kinds nav, sitemap, rss and content.  Feeds
    count 180 and sitemaps 200 whatever else they are; navigation 120 and 40 for
    each repetition; content 100 and its length, if nothing else names it.
    """
    g = links.groupBy(*(by or []), "url").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("nav", "sitemap", "rss", "content")], F.max(F.when(F.col("kind") == "content", F.col("size"))).alias("size"))
    reason = F.when(F.col("rss") > 0, "rss").when(F.col("sitemap") > 0, "sitemap").when(F.col("nav") > 0, "nav").otherwise(urls.important_reason(F.col("url")))
    score = F.when(F.col("rss") > 0, F.lit(180)).when(F.col("sitemap") > 0, F.lit(200)).when(F.col("nav") > 0, 120 + 40 * (F.col("nav") - 1)).otherwise(100 + F.col("size"))
    return g.select(*(by or []), "url", reason.alias("reason"), score.cast("long").alias("score"))


def walk_importance(links: DataFrame, by: list[str], at: list[str]) -> DataFrame:
    """Importance of links as a walk meets them: the columns ``by``, url, reason, score.

    ``links`` has kind, size and the order ``at`` of each sighting.  A feed sets
    180 and a sitemap 200, whatever was there; navigation sets 120 where nothing
    was, and adds 40 else; content sets 100 and its length where nothing was.  A
    group's sightings of one address are as many as the walk has pages.
    """
    when = F.struct(*at)
    first = F.min(F.struct(when.alias("at"), "kind", "size"))
    fixed = F.max(F.when(F.col("kind").isin("rss", "sitemap"), F.struct(when.alias("at"), "kind", "size")))
    g = links.groupBy(*by, "url").agg(F.coalesce(fixed, first).alias("base"), F.collect_list(F.when(F.col("kind") == "nav", when)).alias("navs"))
    more = F.size(F.filter("navs", lambda x: x > F.col("base")["at"]))
    kind = F.col("base.kind")
    score = F.when(kind == "rss", 180).when(kind == "sitemap", 200).when(kind == "nav", 120).otherwise(100 + F.col("base.size")) + 40 * more
    reason = F.when(kind == "content", urls.important_reason(F.col("url"))).otherwise(kind)
    return g.select(*by, "url", reason.alias("reason"), score.cast("long").alias("score"))


def site_walk(load, edges: DataFrame, seeds: DataFrame, judge, max_depth: int, max_pages: int) -> DataFrame:
    """Visits of each crawl in order, level by level, until ``max_pages`` pages are kept.

    ``load(addresses)`` gives the stored pages of a table of urls (unique),
    ``judge(rows)`` adds is_duplicate and matched_on to rows (crawl_id, seq and
    what ``load`` gives), in order of seq.  A visit's ``status`` is kept,
    duplicate or missing; only kept pages count, and only their links are
    followed.  A page is queued once, by its first parent and place.
    """
    level = checkpoint_table(seeds.select("crawl_id", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq")), "frontier")
    seen, visits, kept = level.select("crawl_id", "url"), None, None
    for depth in range(max_depth + 1):
        stored = load(level.select("url").distinct())
        found = level.join(stored, "url")
        both = found if kept is None else kept.select(*found.columns).unionByName(found)
        judged = checkpoint_table(judge(both).where(F.col("depth") == depth), "judged")
        rows = level.select("crawl_id", "url", "depth", "seq").join(judged.drop("url", "depth"), ["crawl_id", "seq"], "left")
        rows = rows.withColumn("status", F.when(F.col("is_duplicate").isNull(), "missing").when(F.col("is_duplicate"), "duplicate").otherwise("kept"))
        before = F.coalesce(F.sum((F.col("status") == "kept").cast("int")).over(Window.partitionBy("crawl_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if kept is not None:
            rows = rows.join(kept.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_had")), "crawl_id", "left").withColumn("_n", before + F.coalesce("_had", F.lit(0))).drop("_had")
        else:
            rows = rows.withColumn("_n", before)
        now = checkpoint_table(rows.where(F.col("_n") < max_pages).drop("_n"), "visits")
        visits = now if visits is None else visits.unionByName(now)
        mine = now.where("status = 'kept'").select(*found.columns)
        kept = mine if kept is None else kept.unionByName(mine)
        if depth == max_depth:
            break
        full = kept.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_pages).select("crawl_id")
        nxt = mine.join(full, "crawl_id", "left_anti").select("crawl_id", F.col("url").alias("src_url"), "seq").join(edges, "src_url")
        nxt = nxt.groupBy("crawl_id", F.col("dst_url").alias("url")).agg(F.min(F.struct("seq", "pos")).alias("o")).join(seen, ["crawl_id", "url"], "left_anti")
        place = F.row_number().over(Window.partitionBy("crawl_id").orderBy("o", "url"))
        level = checkpoint_table(nxt.select("crawl_id", "url", F.lit(depth + 1).alias("depth"), (F.lit(depth + 1).cast("long") * F.lit(1 << 40) + place).alias("seq")), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("crawl_id", "url"))
    return visits


def walk_counters(visits: DataFrame) -> DataFrame:
    """Of each crawl: pages fetched and visited, duplicates, errors (missing pages), greatest depth."""
    of = lambda k: F.count_if(F.col("status") == k)
    return visits.groupBy("crawl_id").agg(of("kept").alias("pages_fetched"), F.count(F.lit(1)).alias("pages_visited"), of("duplicate").alias("duplicates_skipped"), of("missing").alias("errors"), F.max("depth").alias("max_depth_reached"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules for any agent: origin, allow, prefix, from ``robots(origin, body)``.

    A group starts with user-agent lines; those that name ``*`` count.
    """
    body = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace("body", r"\r\n?", "\n"), r"[ \t]*#[^\n]*", ""))
    group = F.regexp_extract_all(body, F.lit(r"(?is)((?:\n\s*user-agent:[^\n]*)+(?:\n(?!\s*user-agent:)[^\n]*)*)"), F.lit(1))
    lines = robots.select("origin", F.explode(group).alias("g")).where(F.col("g").rlike(r"(?i)user-agent:\s*\*"))
    lines = lines.select("origin", F.explode(F.split("g", "\n")).alias("line"))
    rule = F.lower(F.regexp_extract("line", r"(?i)^\s*(allow|disallow)\s*:", 1))
    prefix = F.trim(F.regexp_extract("line", r"(?i)^\s*(?:allow|disallow)\s*:(.*)$", 1))
    return lines.select("origin", rule.alias("rule"), prefix.alias("prefix")).where("rule <> '' and prefix <> ''").select("origin", (F.col("rule") == "allow").alias("allow"), "prefix")


def robots_filter(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages that robots rules allow: the longest matching rule decides, allow wins ties; none allows.

    Rules of one origin are few, so they are gathered per origin and joined.
    """
    r = rules.groupBy("origin").agg(F.collect_list(F.struct("allow", "prefix")).alias("_rules"))
    p = pages.withColumn("_o", urls.origin(F.col(url))).withColumn("_p", F.concat(urls.path(F.col(url)), urls.query(F.col(url))))
    j = p.join(r, p["_o"] == r["origin"], "left").drop("origin")
    plain = lambda x: F.regexp_replace(F.regexp_replace(x["prefix"], r"([\\^.|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    hits = F.filter("_rules", lambda x: F.regexp_like(F.col("_p"), F.concat(F.lit("^"), plain(x))))
    best = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["prefix"]).alias("n"), x["allow"].alias("allow"))))
    return j.where(F.coalesce(best["allow"], F.lit(True))).select(*pages.columns)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap addresses that robots files name: origin, pos, url (relative ones against the origin)."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    v = F.regexp_replace(F.trim("line"), r"(?i)^sitemap:\s*", "")
    lines = lines.where(F.trim("line").rlike("(?i)^sitemap:"))
    return lines.select("origin", "pos", F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), v).when(v.startswith("/"), F.concat("origin", v)).otherwise(F.concat("origin", F.lit("/"), v)).alias("url"))
