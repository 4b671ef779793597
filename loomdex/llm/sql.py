"""DuckDB statements equivalent to the queries of :mod:`.queries`, where SQL can express them."""


def _usable(tables: list[str]) -> str:
    each = " UNION ALL ".join(rf"SELECT '{t}' AS tbl, nullif(lower(regexp_replace(term, '^\s+|\s+$', '', 'g')), '') AS term, doc_id, len(lc) AS n FROM {t}" for t in tables)
    return f"pairs AS (SELECT tbl, term, doc_id, CAST(max(n) AS BIGINT) AS n FROM ({each}) WHERE term IS NOT NULL AND doc_id IS NOT NULL AND n > 0 GROUP BY 1, 2, 3)"


_RANKS = """
items AS (
  SELECT query_id, doc_id, coalesce(max(tf_idf), '-infinity'::DOUBLE) AS a, coalesce(max(pagerank), '-infinity'::DOUBLE) AS b, coalesce(max(phrase), '-infinity'::DOUBLE) AS c
  FROM query_hits WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT query_id, doc_id,
    rank() OVER (PARTITION BY query_id ORDER BY a DESC) + (count(*) OVER (PARTITION BY query_id, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY query_id ORDER BY b DESC) + (count(*) OVER (PARTITION BY query_id, b) - 1) / 2.0 AS rb,
    rank() OVER (PARTITION BY query_id ORDER BY c DESC) + (count(*) OVER (PARTITION BY query_id, c) - 1) / 2.0 AS rc
  FROM items),
ordered AS (SELECT query_id, doc_id, CAST(list_sort([ra, rb, rc])[2] AS DOUBLE) AS median_rank, round(CAST((ra + rb + rc) / 3 AS DOUBLE), 6) AS mean_rank FROM ranked)"""

_COUNTS = f"""
WITH {_usable(['postings', 'category_postings'])},
docs AS (SELECT tbl, count(DISTINCT doc_id) AS docs FROM pairs GROUP BY 1),
counts AS (SELECT tbl, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM pairs GROUP BY 1, 2)"""

SQL = {
    "p2_found": f"""
WITH {_usable(['postings'])},
terms_ AS (SELECT term, count(*) AS df FROM pairs GROUP BY 1),
scored AS (SELECT doc_id, p.term, round((1 + log10(n)) * log10((SELECT count(DISTINCT doc_id) FROM pairs)::DOUBLE / df), 6) AS w FROM pairs p JOIN terms_ t ON t.term = p.term)
SELECT doc_id, term FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) <= 3""",
    "p2_residuals": f"""
WITH {_usable(['postings'])},
c AS (SELECT term, sum(n)::DOUBLE AS c FROM pairs GROUP BY 1),
r AS (SELECT doc_id, sum(n)::DOUBLE AS r FROM pairs GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS t FROM pairs),
e AS (SELECT p.doc_id, p.term, CAST(n AS INTEGER) AS n, r * c / t AS x, (1 - r / t) * (1 - c / t) AS v FROM pairs p JOIN c ON c.term = p.term JOIN r ON r.doc_id = p.doc_id, t)
SELECT doc_id, term, n, round(CASE WHEN x * v > 0 THEN (n - x) / sqrt(x * v) ELSE 0 END, 6) AS weight FROM e""",
    "p5_ranks": f"WITH {_RANKS} SELECT query_id, doc_id, median_rank, mean_rank FROM ordered",
    "p5_found": f"WITH {_RANKS} SELECT query_id, doc_id FROM ordered QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mean_rank, median_rank, doc_id) = 1",
    "p7_counts": f"{_COUNTS} SELECT tbl, term, occurrences, records FROM counts",
    "p7_found": f"""{_COUNTS}
SELECT c.tbl, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM counts c JOIN docs d ON d.tbl = c.tbl WHERE records <= 2 OR records >= 0.2 * docs""",
}
