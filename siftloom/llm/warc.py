"""WARC archives with revisit records.

Writing: payload digests and lengths, without payloads, are shuffled by digest;
of the pages with equal payloads of ``min_bytes`` or more, the one with the
largest id becomes the response and the others revisit it.  Payloads are then
dealt by page id, which no group of copies can make uneven, and written with
fresh headers, one gzip member per record.

Reading: files are parsed record by record; revisit headers are joined to their
original responses by payload digest, which gives them length and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filesystem, scratch, small_batches, write_atomic
from .words import slices

#: Date of the records; a parameter, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _clean(value: str) -> str:
    """A header value: no line ends or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record_id(page_id: int | None, url: str | None, digest: str, number: int = 1) -> str:
    """Record ids follow from the page, so a task that runs again writes the same ones."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{digest}|{number}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers)
    raw = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def plan_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` with body, payload_bytes, payload_digest, number (among equal rows), and refers_to and refers_url for revisits."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("body"))
    heads = p.select("page_id", "url", F.sha1("body").alias("payload_digest"), F.octet_length("body").alias("n")).where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = heads.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("m")).where("m > 1").select("payload_digest", F.col("o.page_id").alias("oid"), F.col("o.url").alias("ourl"))
    # (page, digest) pairs of groups with copies; one row per pair
    known = heads.join(first, "payload_digest").groupBy("page_id", "payload_digest").agg(F.max("oid").alias("oid"), F.max("ourl").alias("ourl"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy(F.col("url").desc_nulls_last()))
    rows = p.withColumn("payload_digest", F.sha1("body")).withColumn("number", number)
    rows = rows.join(known, ["page_id", "payload_digest"], "left")
    # rows of the original's own id: the first is the response
    revisit = F.col("oid").isNotNull() & ~((F.col("oid") == F.col("page_id")) & (F.col("number") == 1))
    return rows.select("page_id", "url", "body", "payload_digest", "number", F.when(revisit, F.col("oid")).alias("refers_to"), F.when(revisit, F.col("ourl")).alias("refers_url"))


def write_archives(pages: DataFrame, min_bytes: int = 1000, out: str | None = None, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as deduplicated archives; returns their manifest (uri, n_records).

    Null html is an empty payload; a null url becomes a ``urn:page:`` address;
    rows without id are always responses.  Rows repeated whole are records of
    their own, of which one is the response.  An empty table writes no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    out = out or scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, n = f"{out}/part-{TaskContext.get().partitionId():07d}.warc.gz", [0]

        def records():
            for b in slices(batches, "body", max_bytes=8 << 20):
                for r in b.to_pylist():
                    if not n[0]:
                        yield _record("warcinfo", [("WARC-Record-ID", record_id(None, uri, "")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    n[0] += 1
                    page, digest = r["page_id"], r["payload_digest"]
                    url = r["url"] if r["url"] is not None else f"urn:page:{page}"
                    head = [("WARC-Record-ID", record_id(page, r["url"], digest, r["number"])), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
                    if page is not None:
                        head.append(("X-Page-ID", str(page)))
                    if r["refers_to"] is None:
                        yield _record("response", head, _HTTP + (r["body"] or b""))
                    else:
                        o_url = r["refers_url"]
                        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_to"], o_url, digest)), ("WARC-Refers-To-Target-URI", o_url if o_url is not None else f"urn:page:{r['refers_to']}"), ("WARC-Refers-To-Date", date)]
                        yield _record("revisit", head, _HTTP)

        it = records()
        first = next(it, None)
        if first is None:
            return
        write_atomic(uri, (x for part in ([first], it) for x in part))
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n[0]]})

    # one row per archive: bounded by the number of partitions
    rows = plan_revisits(pages, min_bytes).mapInArrow(run, "uri string, n_records long").collect()
    return spark.createDataFrame(sorted(rows), "uri string, n_records long")


def parse(chunks) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip stream of records."""
    z, out = zlib.decompressobj(31), []
    for c in chunks:
        while c:
            out.append(z.decompress(c))
            if not z.eof:
                break
            c, raw = z.unused_data, b"".join(out)
            z, out = zlib.decompressobj(31), []
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            yield h, rest[: int(h["content-length"])]
    if out and any(out):
        raise ValueError("the archive ends inside a record")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives as stored: page_id, url, record_type, record_id, payload_digest, refers_to_record, payload_bytes, payload.

    A revisit has neither length nor payload here; a digest that does not fit
    its payload is an error.
    """
    schema = "page_id long, url string, record_type string, record_id string, payload_digest string, refers_to_record string, payload_bytes long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in names[1:6]], ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                f, path = filesystem(uri)
                rows, size = [], 0
                with f.open_input_stream(path, compression=None) as src:
                    for h, block in parse(iter(lambda: src.read(1 << 20), b"")):
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if body is not None and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"digest of {h['warc-record-id']} does not fit its payload")
                        url = h["warc-target-uri"]
                        rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, None if url.startswith("urn:page:") else url, kind, h["warc-record-id"], digest, h.get("warc-refers-to"), None if body is None else len(body), body if payloads else None))
                        size += len(body or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)

    return manifest.select("uri").repartition(max(manifest.count(), 1), "uri").mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Give revisits what their originals have: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Headers are shuffled by digest and joined to the responses that revisits
    name.  A revisit whose response is missing keeps null length and reference.
    """
    heads = records.select("page_id", "record_type", "record_id", "payload_digest", "refers_to_record", "payload_bytes")
    revisits = heads.where("record_type = 'revisit'")
    named = revisits.groupBy("payload_digest", "refers_to_record").agg(F.count(F.lit(1)).alias("times")).select("payload_digest", F.col("refers_to_record").alias("record_id"))
    originals = heads.where("record_type = 'response'").join(named, ["payload_digest", "record_id"], "left_semi").select("payload_digest", F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"))
    found = revisits.join(originals, ["payload_digest", "refers_to_record"], "left").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return heads.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)
