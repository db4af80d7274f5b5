"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from courtline.llm.warc import TRACKING

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, lower: bool) -> str:
    text = f"translate(text, '{_UPPER}', '{_LOWER}')" if lower else "text"
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), []::varchar[])"


OP1 = f"""WITH d AS (SELECT doc_id, {_words(_NORMAL, True)} AS w FROM documents),
 b AS (SELECT CAST(item_id AS varchar) AS item, {_words(_NORMAL, True)} AS w FROM benchmark WHERE item_id IS NOT NULL),
 k AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 s AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
 h AS (SELECT doc_id, s.n, i, item FROM s JOIN k ON s.n = k.n AND s.k = k.k),
 p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
 m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS bigint) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

OP4 = f"""WITH d AS (SELECT doc_id, {_words(_WORD, False)} AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
 f AS (SELECT k, min(doc_id) AS source FROM s GROUP BY k),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM s JOIN f ON s.k = f.k WHERE source < doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.place) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) u ANTI JOIN g ON g.doc_id = u.doc_id AND g.place = u.place GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_TAG = """'"' || md5(html) || '"'"""
_BARE = "page_id % 7 = 6"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(split_part(address, '/', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '')"
OP6 = f"""WITH u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
 v AS (SELECT *, split_part(rest, '?', 1) AS address, array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*[?]?', ''), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{TRACKING}'))), '&') AS params FROM u),
 c AS (SELECT page_id, html, {_HOST} || regexp_replace(regexp_replace(address, '^[^/]*', ''), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url FROM v),
 full_ AS (SELECT page_id AS id, page_id AS place, url, CASE WHEN NOT {_BARE} THEN {_TAG} END AS tag, md5(html) AS digest FROM c),
 again AS (SELECT -page_id - 1 AS id, page_id + 86400 AS place, url, CASE WHEN {_BARE} THEN NULL WHEN page_id % 4 = 3 THEN '"other"' ELSE 'W/' || {_TAG} END AS tag, md5(html) AS digest FROM c),
 j AS (SELECT a.*, f.id AS old, f.tag AS old_tag, f.digest AS old_digest, row_number() OVER (PARTITION BY a.id ORDER BY f.place DESC, f.id DESC) AS k FROM again a LEFT JOIN full_ f ON f.url = a.url AND (f.place < a.place OR (f.place = a.place AND f.id < a.id))),
 o AS (SELECT *, CASE WHEN old IS NULL THEN 'missing' WHEN coalesce(regexp_replace(tag, '^W/', '') = old_tag, digest = old_digest) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE k = 1)
SELECT id AS record_id, url AS canonical_url, old AS refers_to, outcome,
 CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || place || coalesce(';etag=' || coalesce(tag, old_tag), '') END AS headers FROM o"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_WORD, True)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT e.a, e.b FROM e JOIN z x ON x.doc_id = e.a JOIN z y ON y.doc_id = e.b WHERE 100 * e.n >= 75 * (x.n + y.n - e.n)),
 r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
 c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id FROM d LEFT JOIN z ON z.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1, "op4_substring_dedup": OP4, "op6_warc_revisits": OP6, "op10_jaccard_join": OP10}
