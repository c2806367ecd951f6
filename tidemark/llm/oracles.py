"""DuckDB SQL of queries that are too long for their operator's module."""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
m AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

#: Strings of 200 bytes as 400 hexadecimal digits; starts at most 200 apart cover one run.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT rid, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
s AS (SELECT rid, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
o AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM o) GROUP BY rid, run),
g AS (SELECT rid, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS low, a AS high FROM r UNION ALL SELECT d.rid, coalesce(max(b), 0), max(n) FROM d LEFT JOIN r ON r.rid = d.rid GROUP BY d.rid),
k AS (SELECT d.rid, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept FROM g JOIN d ON d.rid = g.rid GROUP BY d.rid)
SELECT doc_id, n AS n_bytes, coalesce((SELECT sum(b - a) FROM r WHERE r.rid = d.rid), 0)::BIGINT AS n_removed, (SELECT count(*) FROM r WHERE r.rid = d.rid)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k ON k.rid = d.rid
"""
