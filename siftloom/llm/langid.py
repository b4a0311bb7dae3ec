"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of

* the likelihood of the text's byte trigrams (a multinomial per language, fitted
  on a sample of labelled texts, tempered because trigrams overlap),
* the probability that a page of that language declares what this one declares,
* the same for the suffix of its address, and
* a prior for its host, smoothed by its domain's, which is smoothed by that of
  all rows.

The last three are estimated from all rows by grouped aggregation of the text's
posteriors, so they need no labels.  Evidence that a row lacks is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches
from .words import LOWER, segment_starts, slices, text_buffers

_SLOTS = 1 << 16


@dataclass(frozen=True)
class Params:
    """``language_rows``: expected number of labelled rows of each language that the text model is fitted on (by a hash of the id).

    More than ``max_languages`` labels are an error.  A row is rejected if its
    text has no letter, if no language reaches ``least``, or if the language
    that fits best gives its trigrams of letters less than a uniform guess would.
    """

    language_rows: int = 5_000
    max_languages: int = 256
    temper: float = 0.2
    smoothing: float = 0.5
    host_pull: float = 20.0
    evidence_pull: float = 10.0
    least: float = 0.5


def held_out() -> Column:
    """Labelled rows that the text model is not fitted on: CRC-32 of the id as text leaves 2 over 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 2, F.lit(False))


def _slots(data: np.ndarray) -> np.ndarray:
    """Table places of the trigrams that end at each byte from the third on."""
    x = LOWER[data].astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64)


def _inner(off: np.ndarray) -> np.ndarray:
    """Ranges of the trigrams that lie inside each document."""
    n = np.maximum(np.diff(off) - 2, 0)
    return n


def train_text(docs: DataFrame, p: Params | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the table of log probabilities (slots x languages) from ``docs(doc_id, text, lang)``.

    Rows without label or held out are not used.  Every language that is left
    is known, however rare.  No labelled rows give one language, ``und``.
    """
    p = p or Params()
    small_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and lang <> ''").where(~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(p.max_languages + 1).collect()}
    if len(sizes) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    langs = sorted(sizes) or ["und"]
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, p.language_rows / n))]) if sizes else F.lit(None)
    part = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < (share[F.col("lang")] * 1_000_000 if sizes else F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            data, off = text_buffers(b.column(0))
            if len(data) < 3:
                continue
            s = _slots(data)
            for i, lang in enumerate(b.column(1).to_pylist()):
                if off[i + 1] - off[i] >= 3:
                    counts.setdefault(lang, np.zeros(_SLOTS, np.int64))
                    counts[lang] += np.bincount(s[off[i] : off[i + 1] - 2], minlength=_SLOTS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "slot", "n"])

    # at most max_languages x 65,536 rows, from a bounded sample
    rows = labelled.where(part).select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((_SLOTS, len(langs)), p.smoothing)
    where = {x: i for i, x in enumerate(langs)}
    table[rows.column(1).to_numpy(), [where[x] for x in rows.column(0).to_pylist()]] += rows.column(2).to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_likelihood(df: DataFrame, key: list[str], langs: list[str], table: np.ndarray, p: Params) -> DataFrame:
    """``key`` columns, has_letters, fits, and tempered log likelihoods (array, one per language).

    ``fits``: under its best language a trigram of letters is no less likely
    than under a uniform guess over the table (true without such trigrams).
    """
    shared = df.sparkSession.sparkContext.broadcast(table)  # of fixed size
    letter = np.zeros(256, dtype=bool)
    letter[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
    from pyspark.sql import types as T

    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("has_letters", T.BooleanType()), T.StructField("fits", T.BooleanType()), T.StructField("loglik", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in slices(batches, max_bytes=1 << 20):
            data, off = text_buffers(b.column(b.num_columns - 1))
            out = np.zeros((b.num_rows, len(langs)), dtype=np.float32)
            some, fits = np.zeros(b.num_rows, dtype=bool), np.ones(b.num_rows, dtype=bool)
            full, starts = segment_starts(off)
            if len(data):
                some[full] = np.logical_or.reduceat(letter[data], starts)
            if len(data) >= 3:
                s, word = _slots(data), letter[data] | (data >= 0x80)
                n = _inner(off)
                own = np.flatnonzero(n)
                bounds = np.concatenate([[0], np.cumsum(n)])
                pick = np.repeat(off[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
                if len(own):
                    logs = t[s[pick]]
                    out[own] = np.add.reduceat(logs, bounds[own], axis=0) * p.temper
                    inner = (word[:-2] & word[1:-1] & word[2:])[pick]
                    logs[~inner] = 0
                    fits[own] = np.add.reduceat(logs, bounds[own], axis=0).max(axis=1) >= -(np.log(_SLOTS) + 1e-3) * np.add.reduceat(inner, bounds[own], dtype=np.int64)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(langs)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(some), pa.array(fits), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.reshape(-1)))], names=schema.names)

    return df.select(*key, "text").mapInArrow(run, schema)


def _posterior(logs: Column, n: int) -> Column:
    """Normalised probabilities from an array of logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _soft_counts(rows: DataFrame, by: list[str], n: int, out: str) -> DataFrame:
    """Sums of the text's posteriors by group (partial sums before the shuffle)."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias(out))


def _shares(counts: Column, prior: Column, pull: float, n: int) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, q: (c + F.lit(pull) * q) / (total + F.lit(pull)))


def identify(df: DataFrame, key: list[str], langs: list[str], table: np.ndarray, p: Params | None = None) -> DataFrame:
    """Language, confidence and acceptance of each row.

    ``df`` holds ``key`` columns, ``text`` and, optionally, ``declared`` (language
    of the markup), ``suffix`` (of the address), ``domain`` and ``host``.  A row
    whose text has no letters has no language (null), confidence 0, and is not
    accepted; nor is one whose text no language fits.  Ties go to the language that comes first by code.
    """
    p, n = p or Params(), len(langs)
    for c in ("declared", "suffix", "domain", "host"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    extra = ["declared", "suffix", "domain", "host"]
    rows = materialise(text_likelihood(df.select(*key, *extra, "text"), [*key, *extra], langs, table, p).withColumn("q", _posterior(F.col("loglik").cast("array<double>"), n)), "likelihoods")
    clear = rows.where("has_letters")
    flat = F.array(*[F.lit(1.0 / n)] * n)
    total = clear.agg(F.array(*[F.coalesce(F.sum(F.col("q")[i]), F.lit(0.0)) for i in range(n)]).alias("all_q"))
    everywhere = total.select(_shares(F.col("all_q"), flat, 1.0, n).alias("overall"))  # one row
    overall = [float(x) for x in everywhere.first().overall]
    base = F.array(*[F.lit(x) for x in overall])
    domains = _soft_counts(clear.where("domain is not null"), ["domain"], n, "dq").select("domain", _shares(F.col("dq"), base, p.host_pull, n).alias("domain_prior"))
    hosts = _soft_counts(clear.where("host is not null"), ["host", "domain"], n, "hq")
    hosts = hosts.join(domains, "domain", "left").select("host", F.col("domain").alias("host_domain"), _shares(F.col("hq"), F.coalesce("domain_prior", base), p.host_pull, n).alias("host_prior"))

    def given(col: str) -> DataFrame:
        """log P(value | language), smoothed towards the value's share of all rows."""
        c = _soft_counts(clear.where(F.col(col).isNotNull()), [col], n, "c")
        sums = c.agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("s")).first().s
        if sums is None or sums[0] is None:
            return c.select(col, F.array(*[F.lit(0.0)] * n).alias(f"{col}_log"))
        whole = float(sum(sums)) or 1.0
        mass = F.aggregate(F.col("c"), F.lit(0.0), lambda a, x: a + x) / F.lit(whole)
        return c.select(col, F.array(*[F.log((F.col("c")[i] + F.lit(p.evidence_pull) * mass) / F.lit(float(sums[i]) + p.evidence_pull)) for i in range(n)]).alias(f"{col}_log"))

    zero = F.array(*[F.lit(0.0)] * n)
    out = rows.join(hosts, (rows["host"] == hosts["host"]) & rows["domain"].eqNullSafe(hosts["host_domain"]), "left").drop(hosts["host"]).drop("host_domain")
    for col in ("declared", "suffix"):
        out = out.join(given(col), col, "left")
    logs = F.zip_with(F.transform("loglik", lambda x: x.cast("double")), F.transform(F.coalesce("host_prior", base), lambda x: F.log(x)), lambda a, b: a + b)
    for col in ("declared", "suffix"):
        logs = F.zip_with(logs, F.coalesce(f"{col}_log", zero), lambda a, b: a + b)
    out = out.withColumn("post", _posterior(logs, n))
    best = F.array_max("post")
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(
        *key,
        F.when(F.col("has_letters"), F.element_at(names, F.array_position("post", best).cast("int"))).alias("language"),
        F.when(F.col("has_letters"), best).otherwise(F.lit(0.0)).alias("confidence"),
        (F.col("has_letters") & F.col("fits") & (best >= p.least)).alias("accepted"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as rows for :func:`identify`: text without tags, markup language, suffix, domain and host."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    some = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id", plain.alias("text"),
        some(F.lower(F.substring(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1), 1, 2))).alias("declared"),
        F.coalesce(some(path), some(F.regexp_extract(host, r"\.([a-z]+)$", 1))).alias("suffix"),
        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), some(host).alias("host"),
    )


def keep_identified(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """``docs`` without the rows that are rejected; all columns stay."""
    p = p or Params()
    langs, table = train_text(docs, p)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.col("source").cast("string").alias("host"))
    bad = materialise(identify(rows, ["doc_id", "text_hash"], langs, table, p).where("not accepted").select("doc_id", "text_hash").distinct(), "rejected")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")
