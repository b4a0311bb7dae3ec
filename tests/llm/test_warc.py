import gzip
import hashlib

from siftloom.llm import warc
from siftloom.llm.store import local_path


def test_round_trip(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (3, "http://b", "short"), (4, "http://c", "short"), (5, "u", None), (6, "v", ""), (7, "w", other), (None, "n", big), (8, "d", "z" * 999), (11, "d", "z" * 999), (12, "q", "r" * 3000), (12, "q", "r" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string").repartition(3)
    manifest = warc.write_archives(df)
    got = sorted((tuple(r) for r in warc.resolve(warc.read_archives(manifest)).collect()), key=str)
    want = []
    for n, (page, _, html) in enumerate(rows):
        b = (html or "").encode()
        same = [i for i, (p, _, h) in enumerate(rows) if (h or "") == (html or "") and p is not None]
        top = max((rows[i][0] for i in same), default=None)
        revisit = len(b) >= 1000 and page is not None and not (page == top and n == min(i for i in same if rows[i][0] == top))
        want.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    raw = b"".join(gzip.decompress(open(local_path(r.uri), "rb").read()) for r in manifest.collect())
    assert raw.count(b"x" * 1200) == 2  # one response and the row without id
    assert raw.count(b"WARC/1.1\r\n") == sum(r.n_records + 1 for r in manifest.collect())
    assert b"\nX: y" not in raw


def test_empty(spark):
    m = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.resolve(warc.read_archives(m)).count() == 0
