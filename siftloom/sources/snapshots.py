"""Page snapshots, documents and search payloads as DataFrames.

Fetching, rendering and live search have side effects and stay outside; their
results enter here as tables, so every query can be repeated.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text, urls


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def snapshots(stored: DataFrame, max_bytes: int = 2_000_000, rendered: bool = False) -> DataFrame:
    """``pages(page_id, url, html)`` as snapshots with final_url, status, content_type, bytes, truncated, extracted_via."""
    size = F.octet_length("html")
    html = F.when(size > max_bytes, F.decode(F.substring(F.encode("html", "utf-8"), 1, max_bytes), "utf-8")).otherwise(F.col("html"))
    return stored.select(
        "page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), html.alias("html"),
        F.least(size, F.lit(max_bytes)).alias("bytes"), (size > max_bytes).alias("truncated"), F.lit("rendered" if rendered else "static").alias("extracted_via"),
    )


#: Settings of a crawl that a single rendered page has no use for.
CRAWL_ONLY = ["max_pages", "max_depth", "same_domain_only", "obey_robots", "delay_ms", "max_chars_per_page"]


def rendered_request(**given) -> dict:
    """Parameters of one rendered page from those of a crawl.

    ``url`` wins over its alias ``start_url``; one of them must be there.  Returns
    the other parameters with ``url``, whether the alias was used, and the names
    of crawl settings that were given in vain.
    """
    own = {k: v for k, v in given.items() if v is not None}
    alias = own.pop("start_url", None)
    url = own.get("url") or alias
    if not url:
        raise ValueError("url or start_url is required")
    vain = [k for k in CRAWL_ONLY if own.pop(k, None) is not None]
    return {"input": {**own, "url": url}, "used_alias": not given.get("url"), "ignored": vain}


def public_only(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address may be fetched (literal addresses are judged; names are not resolved)."""
    return df.where(urls.blocked_reason(F.col(url)).isNull())


# --- documents ---

_HTML_START = "<"


def document_kind(url: Column, content_type: Column, disposition: Column, content: Column, unknown: str = "application/octet-stream") -> Column:
    """struct of kind (pdf, html, text) and content_type from header, suffix, file name and first bytes, in that order.

    ``unknown``: the type of what none of them tells, such as short texts of mostly
    accented letters; callers whose contents are decoded texts know better.
    """
    ct = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    ct = F.when(ct != "", ct)
    ext = urls.extension(url)
    name_ext = F.lower(F.regexp_extract(F.coalesce(urls.disposition_filename(disposition), F.lit("")), r"(\.[^.]*)$", 1))
    head = F.regexp_replace(F.decode(F.substring(content, 1, 512), "iso-8859-1"), r"^[\s\x00-\x1f]+", "")
    yes = lambda c: F.coalesce(c, F.lit(False))
    pdf = yes((ct == "application/pdf") | ct.endswith("+pdf")) | yes(ext == ".pdf") | yes(name_ext == ".pdf") | yes(F.regexp_replace(F.decode(F.substring(content, 1, 32), "iso-8859-1"), r"^[\s\x00-\x1f]+", "").startswith("%PDF-"))
    html = yes(ct.isin("text/html", "application/xhtml+xml") | ct.endswith("+xml")) | yes(ext.isin(".html", ".htm")) | yes(head.startswith(_HTML_START))
    sample = F.decode(F.substring(content, 1, 4096), "iso-8859-1")
    good = F.length(F.regexp_replace(sample, "[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{C2}-\\x{FF}]", ""))
    looks = ~sample.contains("\u0000") & ((F.length(sample) == 0) | (good >= 0.8 * F.length(sample)))
    is_text = yes(ct.startswith("text/") | ct.isin("application/json", "application/xml", "application/xhtml+xml")) | yes(ext.isin(".txt", ".md", ".csv", ".xml", ".json")) | yes(looks)
    own = F.when(ct != "application/octet-stream", ct)
    return (
        F.when(pdf, F.struct(F.lit("pdf").alias("kind"), F.lit("application/pdf").alias("content_type")))
        .when(html, F.struct(F.lit("html").alias("kind"), F.lit("text/html").alias("content_type")))
        .when(is_text, F.struct(F.lit("text").alias("kind"), F.coalesce(own, F.lit("text/plain")).alias("content_type")))
        .otherwise(F.struct(F.lit("text").alias("kind"), F.coalesce(own, F.lit(unknown)).alias("content_type")))
    )


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        h = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        data = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        esc = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else esc.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def pdf_text(data: bytes) -> dict:
    """Title, text and page count of simple PDF files: text operators of plain or Flate streams, in file order.

    Encrypted files, object streams and fonts with their own encodings are
    beyond it; use another reader through ``document_text(pdf_reader=...)``.
    """
    item = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>"
    texts = []
    for m in re.finditer(rb"<<(?:[^>]|>(?!>))*>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        if b"FlateDecode" in m[0][: m[0].find(b"stream")]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        found = []
        for op in re.finditer(rb"(\[(?:[^\]\\]|\\.)*\]|" + item + rb")\s*(TJ|Tj|'|\")", body, re.S):
            found.append("".join(_pdf_string(x) for x in re.findall(item, op[1], re.S)))
        texts.append(re.sub(r"\s+", " ", " ".join(found)).strip())
    title = re.search(rb"/Title\s*(" + item + rb")", data, re.S)
    pages_ = len(re.findall(rb"/Type\s*/Page\b", data))
    return {"title": (_pdf_string(title[1]).strip() or None) if title else None, "text": "\n\n".join(t for t in texts if t), "page_count": pages_}


def document_text(files: DataFrame, max_chars: int = 12_000, pdf_reader=pdf_text) -> DataFrame:
    """``files(final_url, content_type, content_disposition, content)`` as final_url, kind, content_type, title, text, page_count, bytes, truncated."""
    k = document_kind(F.col("final_url"), F.col("content_type"), F.col("content_disposition"), F.col("content"))
    f = files.withColumn("_k", k).withColumn("_t", F.decode("content", "utf-8"))

    @F.pandas_udf("title string, text string, page_count int")
    def read_pdf(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        none = {"title": None, "text": None, "page_count": None}
        return pd.DataFrame([pdf_reader(bytes(c)) if k == "pdf" else none for c, k in zip(content, kind, strict=True)], columns=list(none)).astype(object)

    @F.pandas_udf("title string, text string")
    def read_html(html: pd.Series, url: pd.Series, kind: pd.Series) -> pd.DataFrame:
        from ..operators.extract import extract_page

        none = {"title": None, "main_text": None}
        rows = [extract_page(h, u, ("title", "main_text")) if k == "html" else none for h, u, k in zip(html, url, kind, strict=True)]
        return pd.DataFrame(rows, columns=list(none)).rename(columns={"main_text": "text"}).astype(object)

    f = f.withColumn("_p", read_pdf("content", "_k.kind")).withColumn("_h", read_html("_t", "final_url", "_k.kind"))
    body = F.when(F.col("_k.kind") == "pdf", F.col("_p.text")).when(F.col("_k.kind") == "html", F.col("_h.text")).otherwise(text.plain_text(F.col("_t")))
    cut, more = text.truncate(body, max_chars)
    return f.select("final_url", "_k.kind", "_k.content_type", F.coalesce("_p.title", "_h.title").alias("title"), cut.alias("text"), F.col("_p.page_count").alias("page_count"), F.length("content").alias("bytes"), more.alias("truncated"))


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(name))


# --- a connector for page archives on disk ---


class _HostPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.max_bytes = int(options.get("maxBytes", 2_000_000))

    def partitions(self):
        from pyarrow import fs

        f, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        by_host: dict[str, list[str]] = {}
        for i in f.get_file_info(fs.FileSelector(path, recursive=True)):
            if i.is_file and i.path.endswith(".html"):
                by_host.setdefault(i.path[len(path) :].strip("/").split("/")[0], []).append(i.path)
        return [_HostPartition(sorted(v)) for _, v in sorted(by_host.items())] or [_HostPartition([])]

    def read(self, partition):
        from pyarrow import fs

        f, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for p in partition.files:
            with f.open_input_file(p) as src:
                size = src.size()
                yield "https://" + p[len(root) :].strip("/"), src.read(self.max_bytes).decode("utf-8", "replace"), size, size > self.max_bytes


class PageDirectory(DataSource):
    """``spark.read.format("page_directory")``: files ``<host>/<path>.html`` below a folder, one partition per host."""

    @classmethod
    def name(cls):
        return "page_directory"

    def schema(self):
        return "url string, html string, bytes long, truncated boolean"

    def reader(self, schema):
        return _PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageDirectory)
