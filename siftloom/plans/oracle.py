"""DuckDB SQL for the registered queries.

Small builders below make fragments of SQL text; they follow DuckDB's dialect
(RE2 patterns, no look-around) and share nothing with the Spark expressions but
the fixed word lists.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions import urls as U
from .registry import QUERY

SP = r"[\x09-\x0D \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def runs(x: str, cls: str = "[a-z0-9äöüß]{3,}") -> str:
    return f"regexp_extract_all(lower({x}), '{cls}')"


LATIN = "[a-z0-9À-ſ]{3,}"


def toks(x: str) -> str:
    return f"list_distinct(list_filter({runs(x)}, lambda t: NOT list_contains({lst(T.STOPWORDS)}, t)))"


def uniq(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def cov(x: str) -> str:
    need = T.query_tokens(QUERY)
    return f"(len(list_intersect({lst(need)}, {toks(x)})) / {float(len(need))} * 100.0)"


def r2(x: str) -> str:
    return f"(CASE WHEN ({x})*8 = floor(({x})*8) THEN floor(({x})*100+0.5)/100 ELSE cast(printf('%.2f', ({x})::double) AS double) END)"


def r4(x: str) -> str:
    return f"(CASE WHEN ({x})*32 = floor(({x})*32) THEN floor(({x})*10000+0.5)/10000 ELSE cast(printf('%.4f', ({x})::double) AS double) END)"


def clamp(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


SCHEME = "lower(regexp_extract(url, '^([a-z]+)://', 1))"
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
QS = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
DEPTH = f"len(list_filter(string_split({PATH}, '/'), lambda s: s <> ''))"


def chain(x: str, kinds: dict[str, str], wrap: str = "({})", other: str = "other") -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {q(wrap.format(w))}) THEN {q(k)}" for k, w in kinds.items())
    return f"(CASE {whens} ELSE {q(other)} END)"


SEG = chain("lower(url)", U.SEGMENT_TYPES, "(^|/)({})(/|$)")
SUB = chain(f"({HOST} || ' ' || lower({PATH}))", U.SUBSTRING_TYPES)
STYPE = f"""(CASE WHEN regexp_matches({HOST}, {q(U.GOVERNMENT)}) THEN 'government' WHEN regexp_matches({HOST}, {q(U.SCIENCE)}) THEN 'scientific'
 WHEN regexp_matches({HOST}, {q(U.MEDIA)}) THEN 'major_media' WHEN regexp_matches({HOST}, {q(U.COMMUNITY_HOST)}) OR regexp_matches(lower({PATH}), {q(U.COMMUNITY_PATH)}) THEN 'community'
 WHEN regexp_matches({HOST}, {q(U.OFFICIAL_HOST)}) OR regexp_matches(lower({PATH}), {q(U.OFFICIAL_PATH)}) THEN 'official' ELSE 'unknown' END)"""
STRUCT = f"least(20, (CASE WHEN regexp_matches(lower({PATH}), {q(U.STRUCTURE_WORDS)}) THEN 12 ELSE 0 END) + (CASE WHEN {DEPTH} <= 3 THEN 4 ELSE 0 END) + (CASE WHEN {SCHEME} = 'https' THEN 4 ELSE 0 END))"


def normal(drop=()) -> str:
    kept = f"list_filter(string_split(substr({QS}, 2), '&'), lambda kv: NOT list_contains({lst(drop)}, split_part(kv, '=', 1)))" if drop else None
    query_ = f"(CASE WHEN {QS} = '' OR len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END)" if drop else QS
    return f"({SCHEME} || '://' || {HOST} || {PATH} || {query_})"


TITLED = f"""titled AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url,
 {sq("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')")} AS body, substr(body, 1, 500) AS snippet, (page_id % 12)::int AS position FROM pages)"""

NEED = T.query_tokens(QUERY)


def phrase(v: str) -> str:
    low = f"lower({sq(v)})"
    every = " AND ".join(f"contains({low}, {q(t)})" for t in NEED)
    return f"(CASE WHEN contains({low}, {q(T.squeeze_text(QUERY).lower())}) THEN 15 WHEN {every} THEN 8 ELSE 0 END)"


def score_parts(title: str, snippet: str, pos: str) -> dict[str, str]:
    t, s, u = cov(title), cov(snippet), cov(f"({HOST} || ' ' || {PATH})")
    cover = f"({t}*0.5 + {s}*0.35 + {u}*0.15)"
    bonus = f"({STRUCT} + {phrase(f'({title} || {q(chr(32))} || {snippet})')})"
    pen = f"least(18, greatest(0, {pos})*3)"
    total = clamp(f"{cover}*0.45 + {t}*0.28 + {s}*0.14 + {u}*0.08 + {bonus} - {pen}")
    return {"query_coverage": r2(cover), "title_match": r2(t), "snippet_match": r2(s), "url_match": r2(u), "structure_bonus": f"({bonus})::double", "position_penalty": f"({pen})::double", "total": r2(total)}


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({sq(x)}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 30 AND 320)"


def numbers(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '\\b[0-9]+(?:[.,][0-9]+)?\\b'), lambda s: true)"


def negated(x: str) -> str:
    return f"regexp_matches(lower({x}), '\\b(?:{'|'.join(T.NEGATIONS)})\\b')"


def sig(x: str) -> str:
    words = f"list_filter({runs(x, LATIN)}, lambda t: NOT regexp_full_match(t, '[0-9]+'))"
    return f"array_to_string(list_sort({uniq(words)}[1:8]), '|')"


LNEED = T.query_latin_tokens(QUERY)


def canonical(u: str = "url") -> str:
    return f"regexp_replace(regexp_replace({u}, '[?#].*$', ''), '(\\.html|/)$', '')"


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
PHONE = "\\+?[0-9][0-9\\s\\x0B()/.-]{6,}[0-9]"


def emails(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '{EMAIL}'), lambda e: lower(e)), lambda e: regexp_full_match(e, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'))))"


def phones(x: str) -> str:
    digits = "regexp_replace(e, '[^0-9]', '', 'g')"
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '{PHONE}'), lambda e: length({digits}) BETWEEN 7 AND 15), lambda e: (CASE WHEN e[1] = '+' THEN '+' ELSE '' END) || {digits})))"


def plain(x: str) -> str:
    t = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t\\f\\x0B]+(\\n|$)', '\\1', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def unescape(x: str) -> str:
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


BODY = "regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->', '', 'g')"


def strip(x: str) -> str:
    return unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


PAGE = f"""t AS (SELECT page_id, url, html, {sq(strip("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title, {sq(strip(BODY))} AS full_text,
 {sq(strip("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"))} AS article,
 {strip("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
 {strip(f"regexp_replace(regexp_replace({BODY}, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?(</footer>|$)', '', 'g')")} AS rest FROM pages),
 m AS (SELECT *, CASE WHEN length(article) >= 120 THEN article ELSE {sq("rest || ad")} END AS main FROM t)"""

K = "doc_id"


def extraction(kind_bonus: int, x: str) -> str:
    return clamp(f"{kind_bonus} + least(30, length({sq(x)})/80.0) + least(12, (doc_id%7)*2.5) + least(8, (doc_id%13)*0.8::double) + least(10, (doc_id%9)*1.5) + least(20, (doc_id%9)*2.5) - (CASE WHEN doc_id%5=0 THEN 18 ELSE 0 END)")


def filter_sql() -> str:
    n = normal(["utm_source"])
    path_ = f"(CASE WHEN regexp_full_match({PATH}, '(?i)/de/.*') THEN '/de/*' WHEN regexp_full_match({PATH}, '(?i)/es/.') THEN '/es/?' END)"
    ex = f"(CASE WHEN regexp_matches({n}, '(?i).*/fr/.*') THEN '*/fr/*' END)"
    inc = f"(CASE WHEN regexp_matches({n}, '(?i).*example\\..*') THEN '*example.*' END)"
    reason = f"(CASE WHEN {path_} IS NOT NULL THEN 'exclude_path' WHEN {ex} IS NOT NULL THEN 'exclude_pattern' WHEN {inc} IS NULL THEN 'include_pattern' ELSE 'included' END)"
    return f"SELECT page_id, {reason} = 'included' AS allowed, {reason} AS reason, coalesce({path_}, {ex}, {inc}) AS matched_pattern, {n} AS normalized_url FROM pages"


def profile_sql() -> str:
    k = "page_id"
    q_, w, ratio = f"({k}*7%101)", f"({k}*3%400)", f"(CASE WHEN {k}%4>0 THEN ({k}%100)/100.0 END)"
    steps = [
        [(f"{SCHEME}='https'", 2, "uses https")], [(f"{k}%2=0", 4, "has canonical url")], [(f"{k}%3=0", 4, "has author metadata")], [(f"{k}%5=0", 6, "has publication date")],
        [(f"{w}>250", 4, "has substantial text"), (f"{w}>0 AND {w}<50", -10, "very short content")],
        [(f"{q_}>=80", 6, "high content quality"), (f"{q_}>=60", 3, "good content quality"), (f"{q_}>0 AND {q_}<35", -8, "thin or noisy content")],
        [(f"{ratio}>=0.45", -10, "high boilerplate ratio"), (f"{ratio}<=0.15", 4, "low boilerplate ratio")],
        [(f"regexp_matches(lower({PATH}), {q(U.INDEX_PATH)})", -12, "looks like an index or low-value utility page")],
    ]
    pts = " + ".join("(CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p, _ in g) + " ELSE 0 END)" for g in steps)
    notes = ", ".join("(CASE " + " ".join(f"WHEN {c} THEN {q(n)}" for c, _, n in g) + " END)" for g in steps)
    last = "(CASE st WHEN 'community' THEN 'community source should be cross-checked' WHEN 'unknown' THEN 'source type is not strongly classifiable' ELSE 'classified as ' || st END)"
    base = "(CASE st WHEN 'government' THEN 92 WHEN 'scientific' THEN 88 WHEN 'official' THEN 82 WHEN 'major_media' THEN 72 WHEN 'community' THEN 42 ELSE 55 END)"
    return f"WITH s AS (SELECT *, {STYPE} AS st FROM pages) SELECT page_id, st AS source_type, ({clamp(f'{base} + {pts}')})::bigint AS trust_score, array_to_string(list_filter([{notes}, {last}], lambda n: n IS NOT NULL), '; ') AS notes FROM s"


def private_sql(a: str, b: str) -> str:
    return f"({a} IN (0,10,127) OR ({a}=100 AND {b} BETWEEN 64 AND 127) OR ({a}=169 AND {b}=254) OR ({a}=172 AND {b} BETWEEN 16 AND 31) OR ({a}=192 AND {b}=168) OR ({a}=198 AND {b} IN (18,19)) OR {a}>=224)"


HOSTED = "hosted AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)"
#: Entries of the per-host sitemaps: normalised addresses without fragments, first one of equal ones.
ENTRIES = f"""e AS (SELECT host, {normal()} AS u, '20' || lpad((page_id % 24)::varchar, 2, '0') || '-05-01' AS lastmod, row_number() OVER (PARTITION BY host ORDER BY url) AS pos FROM hosted),
 f AS (SELECT host, u AS url, arg_min(lastmod, pos) AS lastmod FROM e GROUP BY ALL)"""
CONF = "least(100, (CASE WHEN doc_id%2=0 THEN 35 ELSE 15 END) + (CASE WHEN doc_id%3=0 THEN 30 ELSE 0 END) + (CASE WHEN doc_id%4>0 THEN 15 ELSE 0 END) + (CASE WHEN doc_id%5>0 THEN 10 ELSE 0 END) + (CASE WHEN doc_id%7>0 THEN 10 ELSE 0 END) + (CASE WHEN doc_id%11>0 THEN 5 ELSE 0 END) + least(10, (doc_id%8)*2))"
EDGES = "edges AS (SELECT url AS src, lead(url, 1) OVER w AS dst FROM hosted WINDOW w AS (PARTITION BY host ORDER BY page_id) UNION ALL SELECT url, lead(url, 3) OVER w FROM hosted WINDOW w AS (PARTITION BY host ORDER BY page_id))"
_P = score_parts("title", "snippet", "position")
_P0 = score_parts("title", "snippet", "0")
LANG = "(CASE WHEN regexp_matches(lower(url), '/en(/|$)') THEN 6 ELSE 0 END)"
RESULT = r2(clamp(f"{_P0['total']} + {LANG} + (CASE {SEG} WHEN 'docs' THEN 8 WHEN 'blog' THEN 4 WHEN 'category' THEN -6 WHEN 'policy' THEN -6 ELSE 0 END)"))
_REL = score_parts("(title || ' ' || title)", "(' ' || snippet || '  tion')", "0")
NAMES = f"list_filter(string_split({HOST}, '.'), lambda x: length(x) >= 3)"
HAY = f"({HOST} || ' ' || lower({PATH}))"
HEUR = f"(len(list_filter({NAMES}, lambda t: contains({HAY}, t)))*6 + len(list_filter(['org','com'], lambda t: contains({HAY}, t)))*3 + (CASE WHEN {SCHEME}='https' THEN 2 ELSE 0 END) + (CASE WHEN {DEPTH}<=1 THEN 6 ELSE 0 END) + (CASE WHEN regexp_matches({HAY}, '{U.DIRECTORIES}') THEN -40 ELSE 0 END))"

#: Documents of a source one after the other; a row is dropped if a kept one has its canonical address or its text.
GREEDY = """WITH RECURSIVE n AS (SELECT doc_id, source, 'c:' || (length(text) % 40) AS c, 'h:' || sha256(text) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
 walk AS (SELECT source, i, doc_id, false AS dup, NULL::varchar AS how, [c, h] AS kept FROM n WHERE i = 1
 UNION ALL SELECT n.source, n.i, n.doc_id, list_has_any(w.kept, [n.c, n.h]), CASE WHEN list_contains(w.kept, n.c) THEN 'canonical' WHEN list_contains(w.kept, n.h) THEN 'content_hash' END,
 CASE WHEN list_has_any(w.kept, [n.c, n.h]) THEN w.kept ELSE w.kept || [n.c, n.h] END FROM walk w JOIN n ON n.source = w.source AND n.i = w.i + 1)
 SELECT doc_id, dup AS is_duplicate, how AS matched_on FROM walk"""

SQL: dict[str, str] = {
    "url_normalize": f"SELECT page_id, {normal(['utm_source', 'ref'])} AS normalized_url, array_to_string(list_filter(['utm_source','ref'], lambda n: contains({QS}, '?' || n || '=') OR contains({QS}, '&' || n || '=')), ',') AS stripped, {SCHEME} || '://' || {HOST} AS origin FROM pages",
    "url_result_key": f"SELECT page_id, {SCHEME} || '://' || regexp_replace({HOST}, '^www\\.', '') || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') || {QS} AS result_key FROM pages",
    "url_types": f"SELECT page_id, {SEG} AS segment_type, {SUB} AS substring_type, {chain('lower(url)', U.IMPORTANT, other='content')} AS reason, regexp_matches(lower(url), '\\.pdf($|[?#])') AS is_pdf, regexp_matches(lower(url), '{U.DIRECTORIES}') AS is_directory FROM pages",
    "source_type": f"SELECT page_id, {STYPE} AS source_type FROM pages",
    "url_structure": f"WITH {TITLED} SELECT page_id, nullif(lower(regexp_extract({PATH}, '(\\.[^./]*)/*$', 1)), '') AS extension, ({STRUCT})::bigint AS structure_bonus, len({toks(f'({HOST} || {q(chr(32))} || {PATH})')}) AS n_path_tokens, length(body) < 80 OR regexp_matches(lower(url), 'app|dashboard|interactive|viewer|spa|search|results') AS prefers_rendering FROM titled",
    "url_filter": filter_sql(),
    "same_site": f"SELECT page_id, {HOST} = 'therhe.example.org' AS same_host, ({SCHEME} || '://' || {HOST}) = 'https://therhe.example.org' AS same_origin FROM pages",
    "private_ip": f"WITH s AS (SELECT doc_id, doc_id*37%256 AS a, doc_id*11%256 AS b, doc_id%256 AS c FROM documents) SELECT doc_id, a || '.' || b || '.' || c || '.1' AS ip, {private_sql('a', 'b')} AS is_private, CASE WHEN {private_sql('a', 'b')} THEN 'private network' END AS blocked FROM s",
    "contact_page_type": f"WITH {TITLED} SELECT page_id, {chain('lower(url_decode(url) || chr(32) || title || chr(32) || snippet)', U.CONTACT_PAGES)} AS page_type FROM titled",
    "ws_normalize": f"SELECT doc_id, md5({sq('text')}) AS squeezed, md5(substr({sq('text')}, 1, 420)) AS preview, md5(trim(regexp_replace({sq('text')}, ' +([.,!?;:])', '\\1', 'g'))) AS \"inline\", md5({plain('text')}) AS plain FROM documents",
    "token_counts": f"SELECT doc_id, len({runs('text')}) AS n_tokens, len({toks('text')}) AS n_distinct, len(list_distinct({runs('text', LATIN)})) AS n_latin, floor(least(len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda w: w <> '')), 1200)/12.0 + 0.5)::bigint AS word_quality FROM documents",
    "sentence_split": f"SELECT doc_id, len({sentences('text')}) AS n_sentences, md5(array_to_string({sentences('text')}, '|')) AS sentences FROM documents",
    "evidence_top4": f"WITH s AS (SELECT doc_id, unnest({sentences('text')}) AS sentence, generate_subscripts({sentences('text')}, 1) AS pos FROM documents), c AS (SELECT *, floor(len(list_intersect({lst(LNEED)}, list_distinct({runs('sentence', LATIN)})))/{float(len(LNEED))}*100.0+0.5)::bigint AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(sentence), pos) AS rank FROM c WHERE score > 0) SELECT doc_id, rank, score, sentence FROM r WHERE rank <= 4",
    "claim_signature": f"WITH s AS (SELECT doc_id, unnest({sentences('text')}) AS s, generate_subscripts({sentences('text')}, 1) - 1 AS pos FROM documents) SELECT doc_id, pos::bigint AS pos, {sig('s')} AS signature FROM s",
    "numbers_negation": f"SELECT doc_id, array_to_string({numbers('text')}, '|') AS numbers, {negated('text')} AS negated FROM documents",
    "contradiction_notes": f"WITH s AS (SELECT doc_id, {sentences('text')} AS s FROM documents), p AS (SELECT doc_id, unnest(s[:-2]) AS x, unnest(s[2:]) AS y, generate_subscripts(s[2:], 1) - 1 AS pos FROM s WHERE len(s) >= 2), t AS (SELECT doc_id, pos, {numbers('x')} AS a, {numbers('y')} AS b, {negated('x')} AS na, {negated('y')} AS nb FROM p) SELECT doc_id, pos::bigint AS pos, CASE WHEN len(a) > 0 AND len(b) > 0 AND array_to_string(a, '|') <> array_to_string(b, '|') THEN 'mentions ' || array_to_string(b, ', ') || ' instead of ' || array_to_string(a, ', ') WHEN na <> nb THEN 'uses opposite polarity or negation' END AS note FROM t",
    "content_hash": f"SELECT doc_id, sha256(text) AS content_hash, sha256({sq('text')}) AS squeezed_hash FROM documents",
    "source_id": "SELECT page_id, 'src_' || substr(sha1(url), 1, 12) AS source_id, 'lead_' || substr(sha1(CASE WHEN page_id % 2 = 0 THEN url ELSE 'Name|Ort' END), 1, 12) AS lead_id FROM pages",
    "truncation": "SELECT doc_id, md5(substr(text, 1, 800)) AS cut, length(text) > 800 AS truncated FROM documents",
    "page_extraction": f"WITH {PAGE} SELECT page_id, nullif(title, '') AS title, md5(main) AS main_md5, length(main) AS main_chars, sha256(main) AS content_hash, {r4('greatest(0, 1 - length(main)/length(full_text)::double)')} AS boilerplate_ratio, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda h: '1:' || {sq(strip('h'))}), lambda h: h <> '1:'), '|') AS headings FROM m",
    "page_links": "SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS n_links, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS n_nav, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages",
    "snapshot_scan": "SELECT page_id, url AS final_url, 200::bigint AS status, least(strlen(html), 3000)::bigint AS bytes, strlen(html) > 3000 AS truncated FROM pages",
    "document_kinds": "WITH f AS (SELECT doc_id, CASE doc_id%5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.txt' END AS ext, CASE WHEN doc_id%3=0 THEN 'text/plain' WHEN doc_id%7=1 THEN 'application/octet-stream' END AS ct, doc_id%11=0 AS named, doc_id%13 AS m FROM documents), k AS (SELECT *, CASE WHEN ext='.pdf' OR named OR m=0 THEN 'pdf' WHEN ext='.html' OR m=1 THEN 'html' ELSE 'text' END AS kind FROM f) SELECT doc_id, kind, CASE kind WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' ELSE coalesce(nullif(ct, 'application/octet-stream'), 'text/plain') END AS content_type, CASE WHEN named THEN 'a b.pdf' END AS filename FROM k",
    "json_rows": "SELECT '{\"page_id\":' || page_id || ',\"url\":\"' || url || '\"}' AS json FROM pages",
    "extraction_quality": f"SELECT doc_id, {r2('least(30, length(' + sq('text') + ')/80.0)')} AS length_score, {r2('least(12, (doc_id%7)*2.5) + least(8, (doc_id%13)*0.8::double) + least(10, (doc_id%9)*1.5)')} AS structure_score, least(20, (doc_id%9)*2.5)::double AS metadata_score, {r2(extraction(14, 'text'))} AS total, {r2(extraction(18, 'text'))} AS chunks_total, floor({r2(clamp('14 + least(30, length(' + sq('text') + ')/80.0) + least(12, (doc_id%7)*2.5) + least(8, (doc_id%13)*0.8::double) + least(20, (doc_id%9)*2.5) - (CASE WHEN doc_id%5=0 THEN 18 ELSE 0 END)'))} + 0.5)::bigint AS content_quality, {r2(clamp(r2(extraction(18, 'text')) + '*0.6::double + ' + r2(extraction(14, 'text')) + '*0.4::double'))} AS combined FROM documents",
    "source_profile": profile_sql(),
    "search_score": f"WITH {TITLED} SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _P.items())} FROM titled",
    "search_topk": f"WITH {TITLED} SELECT page_id, url, {RESULT} AS quality_score FROM titled ORDER BY quality_score DESC, url COLLATE en LIMIT 10",
    "search_corpus": f"WITH {TITLED} SELECT page_id, {_P0['total']} AS quality_score FROM titled WHERE len(list_intersect({lst(NEED)}, {toks('(title || chr(32) || snippet || chr(32) || url)')})) > 0 ORDER BY quality_score DESC, url COLLATE en LIMIT 10",
    "rerank_position": f"WITH {TITLED} SELECT page_id, {_P['total']} AS quality_score, position::bigint AS position FROM titled",
    "relevance_score": f"WITH {TITLED} SELECT page_id, floor({_REL['total']} + 0.5)::bigint AS relevance FROM titled",
    "extraction_kind": f"WITH {TITLED}, s AS (SELECT page_id, lower(title || ' ' || body || ' ' || url) AS hay, length(body) AS n FROM titled) SELECT page_id, CASE WHEN regexp_matches(hay, '/(login|signin|sign-in|account|search|about|help|faq)\\b') THEN 'markdown' WHEN regexp_matches(hay, 'docs|guide|manual|reference|api|tutorial|article|blog|post|chapter|learn') THEN (CASE WHEN n > 180 THEN 'chunks' ELSE 'markdown' END) WHEN n > 220 THEN 'chunks' ELSE 'markdown' END AS kind FROM s",
    "chunks_fixed": "WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text)=0 THEN 0 ELSE 1 + ceil(greatest(length(text)-1200, 0)/1050.0)::bigint END)) AS i FROM documents), w AS (SELECT doc_id, i*1050 AS s, least(i*1050+1200, n) AS e, trim(substr(text, i*1050+1, 1200)) AS t, i FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no, s AS start_char, e AS end_char, md5(t) AS chunk_md5 FROM w WHERE t <> ''",
    "dedupe_hash": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)",
    "dedupe_greedy": GREEDY,
    "dedupe_canonical": f"WITH c AS (SELECT page_id, {canonical()} AS canonical FROM pages) SELECT min(page_id) AS page_id, arg_min(canonical, page_id) AS canonical FROM c GROUP BY regexp_replace(canonical, '[0-9]+$', '')",
    "dedupe_hits": f"WITH h AS (SELECT page_id, (page_id%4)::int AS variant, regexp_replace({canonical()}, '[0-9]+$', '') AS url FROM pages), k AS (SELECT *, {SCHEME} || '://' || regexp_replace({HOST}, '^www\\.', '') || coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/') AS key FROM h) SELECT variant, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM k GROUP BY variant, key",
    "research_source_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY CASE WHEN doc_id%5=0 THEN 'c' || (doc_id%50) WHEN doc_id%3=0 THEN sha256(text) ELSE doc_id::varchar END",
    "emails_phones": f"SELECT doc_id, array_to_string({emails('text')}, '|') AS emails, array_to_string({phones('text')}, '|') AS phones FROM documents",
    "contacts_merged": f"WITH s AS (SELECT source, doc_id, {emails('text')} AS e, {phones('text')} AS p FROM documents), g AS (SELECT source, list_sort(list_distinct(flatten(list(e)))) AS e, list_sort(list_distinct(flatten(list(p)))) AS p, count(*) AS n_pages, bool_or(doc_id%97=0) AS imp FROM s GROUP BY source) SELECT source, array_to_string(e, '|') AS emails, array_to_string(p, '|') AS phones, n_pages, imp AS impressum_found, least(100, 35 + (CASE WHEN imp THEN 30 ELSE 0 END) + (CASE WHEN len(e)>0 THEN 15 ELSE 0 END) + (CASE WHEN len(p)>0 THEN 10 ELSE 0 END) + least(10, n_pages*2))::bigint AS confidence FROM g",
    "contact_confidence": f"SELECT doc_id, ({CONF})::bigint AS confidence, ({CONF} + (CASE WHEN doc_id%2=0 THEN 10 ELSE 0 END) + (CASE WHEN doc_id%4>0 THEN 10 ELSE 0 END) + (CASE WHEN doc_id%5>0 THEN 8 ELSE 0 END) + (CASE WHEN doc_id%3>0 THEN 4 ELSE 0 END))::bigint AS rank, (CASE WHEN doc_id%3>0 THEN floor((doc_id%90 + {CONF})/2.0 + 0.5) ELSE doc_id%90 END)::bigint AS lead_confidence, CASE WHEN doc_id%3>=2 AND doc_id%100>=75 THEN 'high' WHEN doc_id%3>=1 AND doc_id%100>=60 THEN 'medium' ELSE 'low' END AS claim_confidence FROM documents",
    "website_rank": f"WITH c AS (SELECT page_id%40 AS grp, url, CASE WHEN page_id%3>0 THEN greatest(0, least(100, page_id%90 + (page_id%60)/2.0 + {HEUR} + (page_id%2)*6)) ELSE greatest(0, least(100, {HEUR} + 10)) END AS score FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, url COLLATE en) AS n FROM c), g AS (SELECT grp, list(url ORDER BY n) AS u, max(score) AS best FROM r WHERE n <= 4 GROUP BY grp) SELECT grp, CASE WHEN best >= 25 THEN u[1] END AS best_website, array_to_string(CASE WHEN best >= 25 THEN u[2:4] ELSE u END, ' ') AS alternatives, floor(best + 0.5)::bigint AS confidence FROM g",
    "sitemap_entries": f"WITH {HOSTED}, e AS (SELECT host, {normal()} AS url, '20' || lpad((page_id % 24)::varchar, 2, '0') || '-05-01' AS lastmod FROM hosted) SELECT host, url, lastmod, {SUB} AS inferred_type FROM e",
    "sitemap_groups": f"WITH {HOSTED}, {ENTRIES}, g AS (SELECT host, {SUB} AS label, url FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY host, label ORDER BY url COLLATE en) AS n FROM g) SELECT host, label, count(*) AS n, array_to_string(list(url ORDER BY n) FILTER (n <= 3), ' ') AS sample_urls FROM r GROUP BY host, label",
    "sitemap_targets": f"WITH {HOSTED}, {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY lastmod DESC, url COLLATE en, url) AS rank FROM f) SELECT host, rank, url, lastmod FROM r WHERE rank <= 3",
    "crawl_bfs": f"WITH RECURSIVE {HOSTED}, {EDGES}, walk AS (SELECT host AS crawl_id, arg_min(url, page_id) AS url, 0 AS depth FROM hosted GROUP BY host UNION ALL SELECT w.crawl_id, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.url = e.src WHERE e.dst IS NOT NULL AND w.depth < 3) SELECT crawl_id, url, min(depth)::bigint AS depth FROM walk GROUP BY crawl_id, url",
    "link_importance": f"WITH l AS (SELECT 'http://h/' || (page_id%60) AS url, CASE WHEN page_id%7=0 THEN 'rss' WHEN page_id%11=0 THEN 'sitemap' WHEN page_id%2=0 THEN 'nav' ELSE 'content' END AS kind, length(html) AS size FROM pages), g AS (SELECT url, count(*) FILTER (kind='rss') AS rss, count(*) FILTER (kind='sitemap') AS sm, count(*) FILTER (kind='nav') AS nav, max(size) FILTER (kind='content') AS size FROM l GROUP BY url) SELECT url, CASE WHEN rss>0 THEN 'rss' WHEN sm>0 THEN 'sitemap' WHEN nav>0 THEN 'nav' ELSE {chain('lower(url)', U.IMPORTANT, other='content')} END AS reason, (CASE WHEN rss>0 THEN 180 WHEN sm>0 THEN 200 WHEN nav>0 THEN 120+40*(nav-1) ELSE 100+size END)::bigint AS score FROM g",
    "robots_sitemaps": "WITH o AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, page_id FROM pages) SELECT origin, 3::bigint AS pos, origin || '/s' || page_id || '.xml' AS url FROM o UNION ALL SELECT origin, 4::bigint, 'https://x.example/b.xml' FROM o",
    "robots_filter": f"SELECT page_id FROM pages WHERE NOT ((starts_with({PATH}, '/de') AND NOT starts_with({PATH}, '/de/1')) OR regexp_matches({PATH} || {QS}, '^/fr/.*\\.html'))",
}

# --- compound queries over whole pages ---

#: Extracted pages with quality and profile, as ``x``.
QUALITY = f"""{PAGE}, x0 AS (SELECT *, {r4('greatest(0, 1 - length(main)/length(full_text)::double)')} AS ratio, len({toks('main')}) AS words,
 len(list_filter(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda h: {sq(strip('h'))} <> '')) AS heads, {STYPE} AS st FROM m),
 x1 AS (SELECT *, floor({r2(clamp('14 + least(30, length(main)/80.0::double) + least(12, heads*2.5) + 2.5'))} + 0.5)::bigint AS quality FROM x0),
 x AS (SELECT *, ({clamp("(CASE st WHEN 'government' THEN 92 WHEN 'scientific' THEN 88 WHEN 'official' THEN 82 WHEN 'major_media' THEN 72 WHEN 'community' THEN 42 ELSE 55 END)"
 f" + (CASE WHEN {SCHEME}='https' THEN 2 ELSE 0 END) + (CASE WHEN words > 250 THEN 4 WHEN words > 0 AND words < 50 THEN -10 ELSE 0 END)"
 " + (CASE WHEN quality >= 80 THEN 6 WHEN quality >= 60 THEN 3 WHEN quality > 0 AND quality < 35 THEN -8 ELSE 0 END)"
 " + (CASE WHEN ratio >= 0.45 THEN -10 WHEN ratio <= 0.15 THEN 4 ELSE 0 END)"
 f" + (CASE WHEN regexp_matches(lower({PATH}), {q(U.INDEX_PATH)}) THEN -12 ELSE 0 END)")})::bigint AS trust FROM x1)"""
_HEADS = f"array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda h: {sq(strip('h'))}), lambda h: h <> ''), ' ')"
_SRC = score_parts(f"trim(title || ' ' || {_HEADS})", "trim('  ' || main)", "0")["total"]
_HIT = score_parts(f"trim(title || ' ' || {_HEADS})", "trim(snippet || '  ' || main)", "0")["total"]

SQL["search_and_extract"] = f"""WITH {QUALITY}, h AS (SELECT *, substr(main, 1, 500) AS snippet FROM x WHERE title <> ''),
 k AS (SELECT * FROM h WHERE len(list_intersect({lst(NEED)}, {toks("(title || ' ' || snippet)")})) > 0 QUALIFY row_number() OVER (PARTITION BY sha256(main) ORDER BY page_id) = 1)
 SELECT page_id, title, url, {RESULT} AS quality_score, floor({_HIT} + 0.5)::bigint AS relevance_score, quality AS content_quality_score, trust AS trust_score, st AS source_type,
 substr(main, 1, 8000) AS content, length(main) > 8000 AS content_truncated FROM k ORDER BY quality_score DESC, url COLLATE en LIMIT 10"""

SQL["research_sources"] = f"""WITH {QUALITY}, k AS (SELECT * FROM x WHERE len(list_intersect({lst(NEED)}, {toks("(title || ' ' || main)")})) > 0
 QUALIFY row_number() OVER (PARTITION BY sha256(main) ORDER BY url COLLATE en, url) = 1)
 SELECT 'src_' || substr(sha1(url), 1, 12) AS source_id, nullif(title, '') AS title, url, NULL::varchar AS canonical_url, sha256(main) AS content_hash, st AS source_type, trust AS trust_score,
 floor({_SRC} + 0.5)::bigint AS relevance_score, quality AS content_quality_score, 'static' AS extracted_via, substr(main, 1, 420) AS extracted_preview
 FROM k ORDER BY trust DESC, relevance_score DESC, url COLLATE en LIMIT 8"""

_ALL = strip("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')")
SQL["page_signals"] = f"SELECT page_id, 0::bigint AS n_feeds, regexp_matches({_ALL}, '(?i)login|sign in|anmelden|konto|account') AS login, regexp_matches({_ALL}, '(?i)search|suche') AS search, len({emails(sq(strip(BODY)))}) AS n_emails FROM pages"

#: First part of a title that is no noise; " | Kontakt" follows each title and leaves a single sign.
_FIRST = sq("string_split(regexp_replace(title || ' | Kontakt', ' +[|–:-] +', chr(1), 'g'), chr(1))[1]")
LEAD_NAME = f"(CASE WHEN length({_FIRST}) >= 3 THEN {_FIRST} ELSE {sq("title || ' |'")} END)"
SQL["lead_groups"] = f"""WITH {TITLED}, n AS (SELECT page_id, url, {LEAD_NAME} AS name FROM titled)
 SELECT lower(name) AS group_key, arg_min(name, page_id) AS name, count(*) AS n_hits, count(*) FILTER (regexp_matches(lower(url), '{U.DIRECTORIES}')) AS directory_hits, count(*) AS n_urls,
 string_agg(url, ' ' ORDER BY page_id) AS candidate_urls FROM n GROUP BY lower(name)"""

#: A tree of sitemap indexes: page k names pages 2k+1 and 2k+2 of its table.
SQL["sitemap_expand"] = """WITH RECURSIVE n AS (SELECT page_id AS k, 'https://h.example/' || page_id || '.xml' AS url FROM pages),
 walk AS (SELECT k, url, 0 AS depth FROM n WHERE k = 0 UNION ALL SELECT c.k, c.url, w.depth + 1 FROM walk w JOIN n c ON c.k IN (2*w.k+1, 2*w.k+2) WHERE w.depth < 5)
 SELECT 'https://h.example/0.xml' AS root, url, depth::bigint AS depth FROM walk"""

SQL["length_quality"] = "SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(least(100, floor(length(text) / 120 + 0.5)) AS BIGINT) END AS length_quality FROM documents"

SQL["redacted_details"] = "SELECT doc_id, 'lang,source' AS keys, source FROM documents"

SQL["sitemap_targets_by_type"] = f"""WITH {HOSTED}, {ENTRIES}, k AS (SELECT host, url, lastmod, {SUB} AS kind, {PATH} AS path FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY lastmod, url COLLATE en, url) AS a,
 row_number() OVER (PARTITION BY host ORDER BY path COLLATE en, url) AS b FROM k WHERE kind = 'other')
 SELECT host, 'lastmod_asc' AS sort_by, a AS rank, url FROM r WHERE a <= 3 UNION ALL SELECT host, 'path', b, url FROM r WHERE b <= 3"""

SQL["crawl_sitemap_targets"] = f"""WITH {HOSTED}, {ENTRIES}, r AS (SELECT lower(host) AS host, url, row_number() OVER (PARTITION BY lower(host) ORDER BY lastmod DESC, url COLLATE en, url) AS rank FROM f),
 {QUALITY}, n AS (SELECT url AS final_url, {normal()} AS key, nullif(title, '') AS title, quality FROM x)
 SELECT host, rank, final_url AS url, title, quality AS content_quality_score FROM r JOIN n ON n.key = r.url WHERE rank <= 3"""

#: A crawl of each site as a queue: one step takes one address; addresses and texts of kept pages are its marks.
VISITS = f"""{HOSTED}, {EDGES.replace("AS src, lead(url, 1) OVER w AS dst", "AS src, lead(url, 1) OVER w AS dst, 0 AS pos").replace("lead(url, 3) OVER w FROM", "lead(url, 3) OVER w, 1 FROM")},
 kids AS (SELECT src, list(dst ORDER BY pos, dst) AS dsts FROM (SELECT src, dst, min(pos) AS pos FROM edges WHERE dst IS NOT NULL GROUP BY src, dst) GROUP BY src), {QUALITY},
 one AS (SELECT url, {normal()} AS key, sha256(main) AS hash, nullif(title, '') AS title, quality, words, coalesce(dsts, []) AS dsts FROM x LEFT JOIN kids ON kids.src = x.url QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
 walk AS (SELECT host AS crawl_id, 0 AS step, NULL::varchar AS url, -1 AS depth, NULL::varchar AS status, NULL::varchar AS how, 0 AS kept, [{{'u': arg_min(url, page_id), 'd': 0}}] AS queue, [arg_min(url, page_id)] AS seen, []::varchar[] AS marks FROM hosted GROUP BY host
 UNION ALL SELECT w.crawl_id, w.step + 1, w.queue[1].u, w.queue[1].d, CASE WHEN list_has_any(w.marks, [o.key, o.hash]) THEN 'duplicate' ELSE 'kept' END,
 CASE WHEN list_contains(w.marks, o.key) THEN 'url' WHEN list_contains(w.marks, o.hash) THEN 'content_hash' END, w.kept + (CASE WHEN list_has_any(w.marks, [o.key, o.hash]) THEN 0 ELSE 1 END),
 w.queue[2:] || (CASE WHEN list_has_any(w.marks, [o.key, o.hash]) OR w.queue[1].d >= 2 THEN [] ELSE list_transform(list_filter(o.dsts, lambda t: NOT list_contains(w.seen, t)), lambda t: {{'u': t, 'd': w.queue[1].d + 1}}) END),
 w.seen || (CASE WHEN list_has_any(w.marks, [o.key, o.hash]) OR w.queue[1].d >= 2 THEN [] ELSE o.dsts END), CASE WHEN list_has_any(w.marks, [o.key, o.hash]) THEN w.marks ELSE w.marks || [o.key, o.hash] END
 FROM walk w JOIN one o ON o.url = w.queue[1].u WHERE w.kept < 8 AND len(w.queue) > 0)"""
SQL["crawl_site"] = f"""WITH RECURSIVE {VISITS} SELECT crawl_id, step - 1 AS "order", walk.url, depth::bigint AS depth, status = 'duplicate' AS is_duplicate, how AS matched_on, quality AS content_quality_score FROM walk JOIN one ON one.url = walk.url WHERE step > 0"""
SQL["crawl_counters"] = f"""WITH RECURSIVE {VISITS} SELECT crawl_id, count(*) FILTER (status = 'kept') AS pages_fetched, count(*) AS pages_visited, count(*) FILTER (status = 'duplicate') AS duplicates_skipped, 0::bigint AS errors, max(depth)::bigint AS max_depth_reached FROM walk WHERE step > 0 GROUP BY crawl_id"""

SQL["parsed_hits"] = f"""WITH {TITLED} SELECT page_id, 0::bigint AS position, title, url, substr(body, 1, 500) AS snippet FROM titled WHERE title <> ''"""
SQL["plain_html"] = f"WITH {PAGE} SELECT page_id, nullif(title, '') AS title, md5(substr(full_text, 1, 12000)) AS text_md5, length(substr(full_text, 1, 12000)) AS chars, length(full_text) > 12000 AS text_truncated FROM t"
