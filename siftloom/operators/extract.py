"""Content extraction from HTML: one Python worker pass over each page.

``extract`` adds a struct with the wanted parts.  It is a scalar UDF fed by
Arrow batches, so filters on other columns stay below it and only the columns it
needs are read.  Write its result out (or checkpoint it) before filtering on its
fields: Spark would evaluate the UDF once for each use.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.resolve import resolve
from ..functions.text import SPACE, content_hash
from .dom import Document, Node, parse

_WS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u%04x" % int(m[1], 16), SPACE) + "+")

# Boilerplate, main-content and hidden elements; words of class names; contact patterns.
_BLOCKED_TAGS = {"script", "style", "noscript", "svg", "canvas", "iframe", "header", "footer", "nav", "aside", "form"}
_ARTICLE_CLASS = re.compile("article|content|post|entry|main|docs|markdown|page")
_BOILER_CLASS = re.compile("comment|footer|header|nav|sidebar|menu|breadcrumb")
_CONTACT_WORDS = re.compile("impressum|imprint|legal|kontakt|contact|ansprechpartner|anfahrt|ueber-uns|über-uns|about|company|unternehmen|team|staff|people", re.I)
_CONTACT_PATHS = ["/impressum", "/kontakt", "/contact", "/ueber-uns", "/about", "/team"]
_NAME = "[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]+"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_PERSON = re.compile(_EDGE + r"(?:ansprechpartner(?:in)?|kontaktperson|inhaber(?:in)?|geschäftsführer(?:in)?|vertreten durch|owner|managing director)" + _EDGE + rf"[:\s-]*({_NAME}(?:\s+{_NAME}){{1,2}})", re.I)
_ADDRESS = re.compile(_EDGE + r"([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\- ]{2,}(?:straße|str\.|weg|platz|gasse|allee|ring|ufer|chaussee)\s*[0-9]+[a-zA-Z]?,?\s*[0-9]{5}\s*[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\- ]+)" + _EDGE, re.I)

HEADING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("canonical_url", "meta_description", "lang", "author", "published_at", "modified_at", "og_title", "og_description")])
SECTION = T.StructType([T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])
_STRINGS = T.ArrayType(T.StringType())
PARTS: dict[str, T.DataType] = {
    "title": T.StringType(), "main_text": T.StringType(), "full_length": T.IntegerType(), "headings": T.ArrayType(HEADING), "links": _STRINGS, "metadata": METADATA,
    "all_links": _STRINGS, "sections": T.ArrayType(SECTION), "markdown": T.StringType(), "nav_links": _STRINGS, "feeds": _STRINGS, "login": T.BooleanType(), "search": T.BooleanType(),
    "body_text": T.StringType(), "visible_text": T.StringType(), "mail_links": _STRINGS, "phone_links": _STRINGS, "people": _STRINGS, "address_texts": _STRINGS,
    "linked_data": T.StructType([T.StructField(n, _STRINGS) for n in ("emails", "phones", "addresses", "names")]), "contact_urls": _STRINGS,
}
MAIN = ("title", "main_text", "full_length", "headings", "links", "metadata")


def ws(s: str) -> str:
    return _WS.sub(" ", s).strip(" ")


def _classes(n: Node) -> list[str]:
    return (n.get("class") or "").split()


def _blocked(n: Node) -> bool:
    if n.tag in _BLOCKED_TAGS or n.get("role") in ("navigation", "complementary"):
        return True
    cls, id_ = (n.get("class") or "").lower(), (n.get("id") or "").lower()
    return "cookie" in cls or "consent" in cls or "cookie" in id_ or "consent" in id_ or "cookie" in (n.get("aria-label") or "").lower()


def _hidden(n: Node) -> bool:
    style = (n.get("style") or "").lower()
    return n.tag in ("script", "style", "noscript", "template") or "hidden" in n.attrs or n.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or bool({"hidden", "sr-only"} & set(_classes(n)))


def _drop(top: Node, test) -> None:
    for n in top.find(test):
        n.remove()


_PRIORITY = [
    lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.get("role") == "main", lambda n: "main-content" in _classes(n),
    lambda n: n.get("id") == "main-content", lambda n: n.get("id") == "content", lambda n: "content" in _classes(n),
]


def _score(n: Node) -> float:
    size = len(ws(n.text()))
    if size < 200:
        return -1
    count = lambda *tags: len(n.find(lambda x: x.tag in tags))
    linked = len(ws("".join(a.text() for a in n.find(lambda x: x.tag == "a"))))
    name = f"{n.get('class') or ''} {n.get('id') or ''}".lower()
    bonus = 180 if _ARTICLE_CLASS.search(name) else 0
    loss = 220 if _BOILER_CLASS.search(name) else 0
    return size + 120 * count("p") + 160 * count("h1", "h2", "h3") + 24 * count("li") + bonus - int(linked * 1.4 + 0.5) - loss


def main_scope(doc: Document) -> Node:
    """The element that holds the main content: a telling one with 120 characters, else the best by score."""
    for test in _PRIORITY:
        n = doc.html.first(test)
        if n is not None and len(ws(n.text())) >= 120:
            return n
    best, top = doc.body, _score(doc.body)
    for n in doc.body.walk():
        if (s := _score(n)) > top:
            best, top = n, s
    return best


def _div_text(scope: Node) -> str:
    """Text of the scope, counted again for each ``div`` inside it (the reference text of the content hash)."""
    return scope.text() + "".join(d.text() for d in ([scope] if scope.tag == "div" else []) + scope.find(lambda n: n.tag == "div"))


def _meta(doc: Document, base: str | None) -> dict:
    metas = doc.html.find(lambda n: n.tag == "meta")

    def content(*tests) -> str | None:
        for attr, value in tests:
            if attr == "rel":
                n = doc.html.first(lambda x, v=value: x.get("rel") == v)
            elif attr == "time":
                n = doc.html.first(lambda x: x.tag == "time" and "datetime" in x.attrs)
            else:
                n = next((m for m in metas if m.get(attr) == value), None)
            if n is not None and (v := ws(n.get("content") if n.get("content") is not None else n.text())):
                return v
        return None

    link = doc.html.first(lambda n: n.tag == "link" and n.get("rel") == "canonical")
    href = link.get("href") if link is not None else None
    return {
        "canonical_url": (resolve(href, base, fragment=True) or href) if href and base else href or None,
        "meta_description": content(("name", "description"), ("property", "og:description"), ("name", "twitter:description")),
        "lang": doc.html.get("lang") or None,
        "author": content(("name", "author"), ("property", "article:author"), ("rel", "author")),
        "published_at": content(("property", "article:published_time"), ("name", "pubdate"), ("time", "")),
        "modified_at": content(("property", "article:modified_time"), ("name", "last-modified"), ("http-equiv", "last-modified")),
        "og_title": content(("property", "og:title"), ("name", "twitter:title")),
        "og_description": content(("property", "og:description"), ("name", "twitter:description")),
    }


def _links(top: Node, base: str | None, test=lambda n: True) -> list[str]:
    if not base:
        return []
    found = (resolve(a.get("href"), base) for a in ([top] if top.tag == "a" else []) + top.find(lambda n: n.tag == "a") if a.get("href") and test(a))
    return list(dict.fromkeys(x for x in found if x))


def _inside(n: Node, test) -> bool:
    while n.parent is not None:
        n = n.parent
        if n.tag is not None and test(n):
            return True
    return False


def _sections(scope: Node, main_text: str) -> list[dict]:
    path: list[str | None] = []
    out, buffer = [], []

    def flush() -> None:
        if t := ws(" ".join(buffer)):
            out.append({"heading_path": [p for p in path if p], "text": t})
        buffer.clear()

    for n in ([scope] if scope.tag != "body" else []) + list(scope.walk()):
        if re.fullmatch("h[1-6]", n.tag):
            flush()
            if t := ws(n.text()):
                level = int(n.tag[1])
                del path[level - 1 :]
                path += [None] * (level - 1 - len(path)) + [t]
        elif n.tag in ("p", "li", "pre", "blockquote", "div") and (t := ws(n.text())):
            buffer.append(t)
    flush()
    return out or [{"heading_path": [], "text": main_text}]


def _clean(s: str) -> str:
    return re.sub(r" +([.,!?;:])", r"\1", ws(s)).strip()


def to_markdown(top: Node, base: str, with_links: bool = True) -> str:
    """Headings, paragraphs, lists, quotes and code of an element's children as Markdown."""
    lines: list[str] = []

    def inline(n: Node) -> str:
        if n.tag is None:
            return n.data
        if n.tag == "a":
            text, href = _clean(n.text()), n.get("href")
            return f"[{text}]({resolve(href, base) or href})" if with_links and href and text else text
        if n.tag == "code":
            return f"`{_clean(n.text())}`"
        return "".join(inline(c) for c in n.children)

    def block(n: Node) -> None:
        if n.tag is None:
            lines.append(_clean(n.data))
        elif re.fullmatch("h[1-6]", n.tag):
            if t := _clean(inline(n)):
                lines.append("#" * int(n.tag[1]) + " " + t)
        elif n.tag == "pre":
            if t := n.text().strip():
                lines.append(f"```\n{t}\n```")
        elif n.tag in ("ul", "ol"):
            for i, li in enumerate(c for c in n.children if c.tag == "li"):
                if t := _clean(inline(li)):
                    lines.append(f"{i + 1}. {t}" if n.tag == "ol" else f"- {t}")
        elif n.tag == "blockquote":
            if t := _clean(inline(n)):
                lines.append("> " + t)
        elif n.tag != "p" and (n.tag in ("div", "section", "article", "main") or any(c.tag is not None for c in n.children)):
            for c in n.children:
                block(c)
        else:
            lines.append(_clean(inline(n)))

    block(top) if top.tag not in ("body", "#root") else [block(c) for c in top.children]
    return "\n\n".join(x for x in lines if x).strip()


def _linked_data(doc: Document) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {"emails": [], "phones": [], "addresses": [], "names": []}

    def visit(v) -> None:
        if isinstance(v, list):
            for x in v:
                visit(x)
        elif isinstance(v, dict):
            for key, to in (("email", "emails"), ("telephone", "phones"), ("name", "names"), ("legalName", "names")):
                if isinstance(v.get(key), str):
                    found[to].append(v[key])
            visit(v.get("contactPoint") if isinstance(v.get("contactPoint"), dict | list) else None)
            a = v.get("address")
            if isinstance(a, dict) and (t := ", ".join(a[k] for k in ("streetAddress", "postalCode", "addressLocality") if isinstance(a.get(k), str) and a[k])):
                found["addresses"].append(ws(t))

    for s in doc.root.find(lambda n: n.tag == "script" and n.get("type") == "application/ld+json"):
        try:
            visit(json.loads(s.text()))
        except ValueError:
            continue
    return found


def _contact_urls(doc: Document, base: str, prefer: list[str]) -> list[str]:
    origin = resolve("/", base)
    if origin is None:
        return []
    out = [resolve(p, origin) for p in [*prefer, *_CONTACT_PATHS]]
    for a in doc.html.find(lambda n: n.tag == "a" and n.get("href")):
        u = resolve(a.get("href"), base)
        if u and resolve("/", u) == origin and _CONTACT_WORDS.search(f"{u[len(origin) - 1 :].split('?')[0]} {a.text()}"):
            out.append(u)
    return list(dict.fromkeys(u for u in out if u))


def extract_page(html: str | None, url: str | None, parts: tuple[str, ...] = tuple(PARTS), with_links: bool = True, prefer_paths: tuple[str, ...] = ()) -> dict:
    """The wanted parts of one page.  Null html is an empty page."""
    html = html or ""
    want = set(parts)
    doc = parse(html)
    out: dict = {}
    full = ws(doc.body.text())
    title = doc.root.first(lambda n: n.tag == "title")
    out["title"] = (ws(title.text()) or None) if title is not None else None
    out["full_length"] = len(full)
    if "metadata" in want:
        out["metadata"] = _meta(doc, url)
    if "all_links" in want:
        out["all_links"] = _links(doc.root, url)
    if "nav_links" in want:
        nav = lambda n: n.tag in ("nav", "header") or n.get("role") == "navigation"
        out["nav_links"] = _links(doc.root, url, lambda a: _inside(a, nav))
    if want & {"feeds", "login", "search"}:
        alternate = doc.html.find(lambda n: n.tag == "link" and n.get("rel") == "alternate" and re.search("rss|atom", n.get("type") or "") is not None)
        out["feeds"] = list(dict.fromkeys(u for u in (resolve(n.get("href"), url or "", fragment=True) for n in alternate if n.get("href")) if u))
        words = doc.root.text()
        field = lambda kind: doc.html.first(lambda n: n.tag == "input" and n.get("type") == kind) is not None
        out["login"] = field("password") or re.search("login|sign in|anmelden|konto|account", words, re.I) is not None
        out["search"] = field("search") or doc.html.first(lambda n: n.tag == "form" and "search" in (n.get("action") or "").lower()) is not None or re.search("search|suche", words, re.I) is not None
    if "linked_data" in want:
        out["linked_data"] = _linked_data(doc)
    if "contact_urls" in want:
        out["contact_urls"] = _contact_urls(doc, url or "", list(prefer_paths))
    if "body_text" in want:
        bare = parse(html)
        _drop(bare.root, lambda n: n.tag in ("script", "style", "noscript"))
        out["body_text"] = ws(bare.body.text() or bare.root.text())
    if want & {"visible_text", "mail_links", "phone_links", "people", "address_texts"}:
        seen = parse(html)
        _drop(seen.root, _hidden)
        text = ws(seen.body.text())
        anchors = seen.html.find(lambda n: n.tag == "a" and n.get("href"))
        out |= {"visible_text": text, "mail_links": [a.get("href") for a in anchors if a.get("href").startswith("mailto:")], "phone_links": [a.get("href") for a in anchors if a.get("href").startswith("tel:")]}
        out |= {"people": [ws(m[1]) for m in _PERSON.finditer(text)], "address_texts": [ws(m[1]) for m in _ADDRESS.finditer(text)]}
    if want & {"main_text", "headings", "links", "sections", "markdown"}:
        _drop(doc.root, _blocked)
        scope = main_scope(doc)
        main = ws(_div_text(scope)) or ws(doc.body.text())
        out["main_text"] = main
        heads = [n for n in ([scope] if re.fullmatch("h[1-6]", scope.tag) else []) + scope.find(lambda n: re.fullmatch("h[1-6]", n.tag) is not None)]
        out["headings"] = [{"level": int(n.tag[1]), "text": t, "id": n.get("id") or None} for n in heads if (t := ws(n.text()))]
        if "links" in want:
            out["links"] = _links(scope, url)
        if "sections" in want:
            out["sections"] = _sections(scope, main)
        if "markdown" in want:
            out["markdown"] = to_markdown(scope, url or "", with_links)
    return {k: out.get(k) for k in parts}


def extractor(parts: tuple[str, ...] = MAIN, with_links: bool = True, prefer_paths: tuple[str, ...] = ()):
    """A UDF of (html, url) that returns a struct of the wanted parts."""
    schema = T.StructType([T.StructField(p, PARTS[p]) for p in parts])

    @F.pandas_udf(schema)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [extract_page(h, u, parts, with_links, prefer_paths) for h, u in zip(html, url, strict=True)]
        return pd.DataFrame(rows, columns=list(parts)).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=list(parts))

    return run


def boilerplate_ratio(main_length: Column, full_length: Column) -> Column:
    """Share of the page's text outside the main text, four decimals; null for pages without text."""
    x = F.greatest(F.lit(0.0), 1.0 - main_length / full_length.cast("double"))
    tie = x * 32 == F.floor(x * 32).cast("double")
    exact = F.when(tie, F.floor(x * 10000 + 0.5) / 10000.0).otherwise(F.replace(F.format_number(x, 4), F.lit(","), F.lit("")).cast("double"))
    return F.when(full_length > 0, exact)


def extract(snapshots: DataFrame, parts: tuple[str, ...] = MAIN, max_chars: int | None = None, url_col: str = "final_url", **options) -> DataFrame:
    """Add the parts of each page as columns, with content_hash, boilerplate_ratio and truncated where they apply."""
    df = snapshots.withColumn("_x", extractor(parts, **options)(F.col("html"), F.col(url_col)))
    df = df.select(*[c for c in snapshots.columns if c not in parts], *[F.col(f"_x.{p}").alias(p) for p in parts])
    if "main_text" in parts:
        df = df.withColumn("content_hash", content_hash(F.col("main_text")))
        if "full_length" in parts:
            df = df.withColumn("boilerplate_ratio", boilerplate_ratio(F.length("main_text"), F.col("full_length")))
        if max_chars:
            df = df.withColumn("truncated", F.length("main_text") > max_chars).withColumn("main_text", F.substring("main_text", 1, max_chars))
        else:
            df = df.withColumn("truncated", F.lit(False))
    return df
