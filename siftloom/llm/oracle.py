"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * c >= 80 * (len(sx.s) + len(sy.s) - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.y, r.m FROM r JOIN u ON r.v = u.x),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT doc_id, len(s) AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN c ON doc_id = v
"""

WARC_REVISITS = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS o FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN o IS NOT NULL AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN o <> page_id THEN o END AS refers_to FROM p LEFT JOIN o USING (d)
"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS t FROM bi),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS t FROM di),
hit AS (SELECT doc_id, item_id, i, dg.n AS n FROM dg JOIN win ON dg.t = win.t AND dg.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
