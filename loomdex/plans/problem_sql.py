"""DuckDB statements equivalent to the queries of :mod:`.problems`."""

_TARGET = r"nullif(regexp_replace(replace(regexp_extract({x}, '^[^#|]*'), '_', ' '), '^\s+|\s+$', '', 'g'), '')"
_TERM = r"nullif(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '')"

_REFS = f"""
raw AS (
  SELECT 'pages.redirect' AS ref_field, id AS src_id, redirect AS r, epoch_us(edited_at) AS tm FROM pages WHERE id IS NOT NULL
  UNION ALL
  SELECT 'pages.links', id, unnest(links), epoch_us(edited_at) FROM pages WHERE id IS NOT NULL),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT ref_field, src_id, {_TARGET.format(x='r')} AS target_key, tm FROM raw
    UNION ALL
    SELECT 'edges.dst', src, CAST(dst AS VARCHAR), epoch_us(seen_at) FROM edges)
  WHERE target_key IS NOT NULL AND tm IS NOT NULL),
spans AS (
  SELECT DISTINCT * FROM (
    SELECT 't' AS space, title AS k, coalesce(epoch_us(added_at), -9e18) AS b, coalesce(epoch_us(removed_at), 9e18) AS e FROM titles
    UNION ALL
    SELECT 'i', CAST(id AS VARCHAR), coalesce(epoch_us(added_at), -9e18), coalesce(epoch_us(removed_at), 9e18) FROM titles)
  WHERE k IS NOT NULL)"""

_ROWS = f"""
rows_ AS (
  SELECT 'postings.term' AS key_field, {_TERM.format(x='term')} AS key_value, doc_id AS v FROM postings
  UNION ALL
  SELECT 'pages.links', {_TARGET.format(x='l')}, id FROM (SELECT id, unnest(links) AS l FROM pages)
  UNION ALL
  SELECT 'edges.dst', CAST(dst AS VARCHAR), src FROM edges),
kept AS (SELECT * FROM rows_ WHERE key_value IS NOT NULL)"""

_PARENTS = f"""
cur AS (
  SELECT id, title, {_TARGET.format(x='redirect')} AS t FROM pages WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY edited_at DESC NULLS LAST, loaded_at DESC NULLS LAST, title DESC NULLS LAST, redirect DESC NULLS LAST) = 1),
named AS (SELECT title, min(id) AS parent FROM cur WHERE title IS NOT NULL GROUP BY title),
link AS (SELECT c.id AS node, n.parent FROM cur c JOIN named n ON c.t = n.title),
walk AS (
  SELECT node AS root, node AS node, 0 AS depth, CAST(node AS VARCHAR) AS path FROM (SELECT parent AS node FROM link EXCEPT SELECT node FROM link)
  UNION ALL
  SELECT w.root, l.node, w.depth + 1, w.path || '/' || CAST(l.node AS VARCHAR) FROM walk w JOIN link l ON l.parent = w.node),
pairs AS (
  SELECT node AS d, parent AS a, 1 AS distance FROM link WHERE node IN (SELECT node FROM walk)
  UNION ALL
  SELECT p.d, l.parent, p.distance + 1 FROM pairs p JOIN link l ON l.node = p.a)"""

SQL = {
    "p3_found": f"""
WITH {_REFS},
probed AS (
  SELECT r.ref_field, r.src_id, r.target_key, r.tm AS tm, count(s.k) AS n, coalesce(max(CASE WHEN s.b <= r.tm AND s.e > r.tm THEN 1 ELSE 0 END), 0) AS there,
         coalesce(max(CASE WHEN s.k IS NOT NULL AND s.e <= r.tm THEN 1 ELSE 0 END), 0) AS ended
  FROM refs r LEFT JOIN spans s ON s.k = r.target_key AND s.space = CASE WHEN r.ref_field = 'edges.dst' THEN 'i' ELSE 't' END
  GROUP BY ALL)
SELECT DISTINCT ref_field, src_id, target_key, CASE WHEN n = 0 THEN 'missing' WHEN ended = 1 THEN 'deleted' ELSE 'late' END AS reason,
       strftime(make_timestamp(tm), '%Y-%m') AS ref_month
FROM probed WHERE there = 0""",
    "p3_snapshots": f"""
WITH {_REFS},
eff AS (SELECT space, k, b, e, e <= b AS empty FROM spans),
probed AS (
  SELECT r.ref_field, r.src_id, r.target_key, r.tm AS tm, CASE WHEN r.ref_field = 'edges.dst' THEN 'i' ELSE 't' END AS space,
         coalesce(max(CASE WHEN s.b <= r.tm AND s.e > r.tm THEN 1 ELSE 0 END), 0) AS there, coalesce(max(CASE WHEN s.k IS NOT NULL AND s.e <= r.tm THEN 1 ELSE 0 END), 0) AS ended
  FROM refs r LEFT JOIN spans s ON s.k = r.target_key AND s.space = CASE WHEN r.ref_field = 'edges.dst' THEN 'i' ELSE 't' END
  GROUP BY ALL),
lost AS (SELECT *, date_trunc('month', make_timestamp(tm)) AS own FROM probed WHERE there = 0),
last_ AS (SELECT greatest((SELECT max(make_timestamp(epoch_us(t))) FROM (SELECT edited_at AS t FROM pages UNION ALL SELECT seen_at FROM edges)),
                          coalesce((SELECT max(make_timestamp(CAST(x AS BIGINT))) FROM (SELECT b AS x FROM eff UNION ALL SELECT e FROM eff) WHERE abs(x) < 8e18), TIMESTAMP '1970-01-01')) AS t),
ends AS (SELECT unnest(generate_series((SELECT min(own) FROM lost) + INTERVAL 1 MONTH, (SELECT date_trunc('month', t) FROM last_) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m),
stood AS (
  SELECT l.*, m, coalesce(max(CASE WHEN (CASE WHEN s.empty THEN s.e ELSE s.b END) < epoch_us(m) THEN 1 ELSE 0 END), 0) AS arrived,
         coalesce(max(CASE WHEN NOT s.empty AND s.b < epoch_us(m) AND s.e >= epoch_us(m) THEN 1 ELSE 0 END), 0) AS now_there
  FROM lost l JOIN ends ON m > own LEFT JOIN eff s ON s.space = l.space AND s.k = l.target_key GROUP BY ALL)
SELECT strftime(m, '%Y-%m-%d') AS as_of, ref_field AS field, strftime(own, '%Y-%m') AS month, CASE WHEN ended = 1 THEN 'deleted' WHEN arrived = 1 THEN 'late' ELSE 'waiting' END AS reason,
       now_there = 0 AS open, count(*) AS n
FROM stood GROUP BY ALL""",
    "p4_found": f"""
WITH {_ROWS}
SELECT key_field, key_value FROM (SELECT key_field, key_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY key_field) AS total FROM kept GROUP BY 1, 2)
WHERE n >= 0.02 * total""",
    "p4_quantiles": f"""
WITH {_ROWS},
placed AS (
  SELECT key_field, key_value, v, count(*) OVER k AS n, count(v) OVER k AS c, row_number() OVER (PARTITION BY key_field, key_value ORDER BY v NULLS LAST) AS i
  FROM kept WINDOW k AS (PARTITION BY key_field, key_value))
SELECT key_field, key_value, max(n) AS n, max(CASE WHEN i = greatest(1, ceil(0.25 * c)) THEN v END) AS q25,
       max(CASE WHEN i = greatest(1, ceil(0.5 * c)) THEN v END) AS q50, max(CASE WHEN i = greatest(1, ceil(0.75 * c)) THEN v END) AS q75
FROM placed GROUP BY 1, 2""",
    "p6_found": f"""
WITH RECURSIVE {_PARENTS}
SELECT l.node AS page_id, coalesce(w.root, -1) AS root_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS node_depth FROM link l LEFT JOIN walk w ON w.node = l.node""",
    "p6_descendants": f"""
WITH RECURSIVE {_PARENTS}
SELECT a AS page_id, d AS descendant_id, CAST(distance AS BIGINT) AS distance FROM pairs""",
    "p6_paths": f"""
WITH RECURSIVE {_PARENTS},
below AS (SELECT a, count(*) AS c FROM pairs GROUP BY a),
every AS (SELECT node FROM link UNION SELECT node FROM walk)
SELECT e.node AS page_id, coalesce(w.root, -1) AS root_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS node_depth, w.path, coalesce(b.c, 0) AS descendants
FROM every e LEFT JOIN walk w ON w.node = e.node LEFT JOIN below b ON b.a = e.node""",
}
