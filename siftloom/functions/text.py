"""Text functions as Column expressions.

All are built-in expressions; the array functions among them are evaluated
row by row in the JVM.  Character classes are spelled out, because ``\\s``,
``\\b`` and ``\\d`` differ between regular-expression dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, stop words (English and German), negations.
SPACE = r"[\x09-\x0D \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOPWORDS = ["and", "or", "the", "a", "an", "to", "of", "in", "for", "on", "with", "from", "by", "der", "die", "das", "ein", "eine", "und", "oder", "mit", "für", "fur", "im", "am", "den", "dem", "des"]
NEGATIONS = ["no", "not", "never", "none", "kein", "keine", "ohne", "nicht"]
#: A word boundary between ASCII word characters and others.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
WORD_RUN = "[a-z0-9äöüß]{3,}"
LATIN_RUN = "[a-z0-9À-ſ]{3,}"


def words_of(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def tokens(c: Column) -> Column:
    """Distinct words of three characters or more that aren't stop words, in order of occurrence."""
    return F.array_except(F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), F.lit(0)), words_of(*STOPWORDS))


def lead_tokens(c: Column) -> Column:
    """Words of three characters or more, with repetitions and stop words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), F.lit(0))


def latin_tokens(c: Column) -> Column:
    """Distinct words of three characters or more with Latin letters, stop words included."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(LATIN_RUN), F.lit(0)))


def query_tokens(query: str) -> list[str]:
    """:func:`tokens` of a parameter, worked out once."""
    return list(dict.fromkeys(t for t in re.findall(WORD_RUN, query.lower()) if t not in STOPWORDS))


def query_latin_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(LATIN_RUN, query.lower())))


def squeeze_text(value: str) -> str:
    """:func:`squeeze` of a parameter."""
    return re.sub("[\t-\r    -     　﻿]+", " ", value).strip(" ")


def coverage(needles: list[str], hay: Column) -> Column:
    """Share of needles found, in per cent; 0 without needles."""
    if not needles:
        return F.lit(0.0)
    return F.size(F.array_intersect(words_of(*needles), hay)) / F.lit(float(len(needles))) * 100.0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def sentences(c: Column) -> Column:
    """Sentences of 30 to 320 characters."""
    return F.filter(F.transform(F.split(squeeze(c), r"(?<=[.!?]) +"), lambda s: F.trim(s)), lambda s: F.length(s).between(30, 320))


def signature(c: Column) -> Column:
    """First eight distinct tokens that aren't numbers, sorted and joined by ``|``."""
    return signature_of(latin_tokens(c))


def signature_of(tokens: Column) -> Column:
    """:func:`signature` from :func:`latin_tokens`."""
    words = F.filter(tokens, lambda t: ~((t < ":") & t.rlike("^[0-9]+$")))
    return F.array_join(F.sort_array(F.slice(words, 1, 8)), "|")


def evidence_score(query: str, sentence: Column) -> Column:
    """Share of the query's tokens in a sentence, rounded per cent."""
    need = query_latin_tokens(query)
    if not need:
        return F.lit(0)
    return F.floor(F.size(F.array_intersect(words_of(*need), latin_tokens(sentence))) / F.lit(float(len(need))) * 100.0 + 0.5).cast("int")


def numbers(c: Column) -> Column:
    """Numbers with an optional decimal part, between word boundaries."""
    return F.regexp_extract_all(c, F.lit(EDGE + r"[0-9]+(?:[.,][0-9]+)?" + EDGE), F.lit(0))


def negated(c: Column) -> Column:
    return F.lower(c).rlike(EDGE + "(?:" + "|".join(NEGATIONS) + ")" + EDGE)


def contradiction(claim: Column, evidence: Column) -> Column:
    """Why a sentence speaks against a claim, or null."""
    a, b = numbers(claim), numbers(evidence)
    differ = (F.size(a) > 0) & (F.size(b) > 0) & (F.array_join(a, "|") != F.array_join(b, "|"))
    said = F.concat(F.lit("mentions "), F.array_join(b, ", "), F.lit(" instead of "), F.array_join(a, ", "))
    return F.when(differ, said).when(negated(claim) != negated(evidence), "uses opposite polarity or negation")


def preview(c: Column) -> Column:
    return F.substring(squeeze(c), 1, 420)


def clean_inline(c: Column) -> Column:
    """Squeezed, without blanks before punctuation."""
    return F.trim(F.regexp_replace(squeeze(c), " +([.,!?;:])", "$1"))


def plain_text(c: Column) -> Column:
    """Unified line ends, no blanks at line ends, single blanks, at most one empty line in a row."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+(\n|$)", "$1")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), f"^{SPACE}+|{SPACE}+$", "")


def truncate(c: Column, n: int) -> tuple[Column, Column]:
    """First ``n`` characters and whether more were there."""
    return F.substring(c, 1, n), F.length(c) > n


def truncate_bytes(c: Column, n: int) -> tuple[Column, Column]:
    """First ``n`` UTF-8 bytes, a character cut in two left out, and whether more were there."""
    raw = F.encode(c, "utf-8")
    cut = F.regexp_replace(F.decode(F.substring(raw, 1, n), "iso-8859-1"), "(?:[\u00c2-\u00df]|[\u00e0-\u00ef][\u0080-\u00bf]?|[\u00f0-\u00f4][\u0080-\u00bf]{0,2})$", "")
    short = F.decode(F.encode(cut, "iso-8859-1"), "utf-8")
    more = F.octet_length(c) > n
    return F.when(more, short).otherwise(c), more


def word_quality(c: Column) -> Column:
    """Quality of plain documents by their number of words."""
    n = F.size(F.filter(F.split(c, SPACE + "+"), lambda w: w != ""))
    return F.floor(F.least(n, F.lit(1200)) / 12.0 + 0.5).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(c.cast("string")), 1, 12))


def round2(x: Column) -> Column:
    """Two decimals of the exact binary value, ties up."""
    tie = x * 8 == F.floor(x * 8).cast("double")
    return F.when(tie, F.floor(x * 100 + 0.5) / 100.0).otherwise(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")).cast("double"))


def round0(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def bounded(name: str, value: int, least: int, most: int) -> int:
    """``value`` if it lies in its range, else an error."""
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise ValueError(f"{name} must be an integer from {least} to {most}, not {value!r}")
    return value


def length_quality(c: Column) -> Column:
    """Quality of text without markup, by its length: 0 to 100, null for null."""
    return F.when(c.isNotNull(), F.least(F.lit(100), F.floor(F.length(c) / 120 + 0.5))).cast("int")


#: Keys of details that never reach a log.
BLOCKED_KEYS = ["text", "html", "content", "token", "authorization", "body"]


def redacted(details: Column) -> Column:
    """A map of details without its blocked keys (in any case)."""
    return F.map_filter(details, lambda k, v: ~F.lower(k).isin(*BLOCKED_KEYS))
