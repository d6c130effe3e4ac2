"""DuckDB SQL for the queries that SQL expresses over whole tables in reasonable time."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of documents that share a shingle, then reachability.
NEARDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Every 50-byte window with the least doc_id that has it; bytes are two hexadecimal digits.
SUFFIX = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), v AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, greatest(n - 48, 1))) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM v GROUP BY s
), c AS (
  SELECT v.doc_id, v.i FROM v JOIN f ON f.s = v.s WHERE f.first < v.doc_id
), k AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS jump FROM c
), g AS (
  SELECT doc_id, i, sum(jump) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM k
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span
), q AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS z FROM s
), x AS (
  SELECT q.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) AS kept
  FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(x.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN x.doc_id IS NULL THEN d.h ELSE x.kept || substr(d.h, 2 * x.last - 1) END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
