"""DuckDB statements equivalent to the queries of :mod:`.search_queries`."""

from ..functions.text import KEPT_SIGNS, KEPT_WORDS, MAX_EN, PUNCTUATION, STOP_WORDS, simplified
from .problem_sql import _TARGET
from .search_queries import PREFIXES, QUERIES, T2S

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_STOP = "[" + ", ".join(map(_quote, STOP_WORDS)) + "]"
_CHARS = _quote(PUNCTUATION)

_LINES = "list_filter(string_split({x}, chr(10)), lambda x: x <> '')"
_DOCS = f"""
docs AS (
  SELECT doc_id, text, list_transform(list_filter(string_split(translate(array_to_string({_LINES.format(x='text')}, ' '), {_CHARS}, ''), ' '),
         lambda w: regexp_full_match(w, '[A-Za-z]{{1,{MAX_EN}}}') AND NOT list_contains({_STOP}, w)), lambda w: lower(w)) AS t
  FROM documents WHERE text IS NOT NULL)"""
_POSTINGS = f"""{_DOCS},
pos AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM docs),
post AS (SELECT term, doc_id, count(*) AS n, list(p ORDER BY p) AS lc FROM pos GROUP BY 1, 2),
terms_ AS (SELECT term, count(*) AS df, round(log10((SELECT count(*) FROM docs)::DOUBLE / count(*)), 4) AS idf FROM post GROUP BY 1),
weighted AS (SELECT p.term, doc_id, n, lc, round(1 + log10(n), 4) AS tf, round(round(1 + log10(n), 4) * idf, 4) AS tf_idf, idf FROM post p JOIN terms_ t ON t.term = p.term),
norms AS (SELECT doc_id, sqrt(sum(tf_idf * tf_idf)) AS norm FROM weighted GROUP BY 1)"""
_QUERIES = "(VALUES " + ", ".join(f"({i}, {_quote(q)})" for i, q in enumerate(QUERIES)) + ") q(query_id, query)"
_ANALYSED = f"""
words AS (SELECT CAST(query_id AS BIGINT) AS query_id, unnest(string_split(lower(query), ' ')) AS term, generate_subscripts(string_split(lower(query), ' '), 1) - 1 AS place FROM {_QUERIES}),
analysed AS (SELECT w.*, t.idf, t.idf IS NOT NULL AND NOT list_contains({_STOP}, w.term) AS kept FROM words w LEFT JOIN terms_ t ON t.term = w.term)"""
_FOUND = f"""{_POSTINGS}, {_ANALYSED},
vec AS (SELECT query_id, term, (1 + log10(count(*))) * any_value(idf) AS weight FROM analysed WHERE kept GROUP BY 1, 2),
len AS (SELECT query_id, sqrt(sum(weight * weight)) AS length FROM vec GROUP BY 1),
dots AS (SELECT query_id, doc_id, sum(weight * tf_idf) AS dot FROM vec v JOIN weighted w ON w.term = v.term GROUP BY 1, 2),
big AS (SELECT query_id, term AS a, lead(term) OVER (PARTITION BY query_id ORDER BY place) AS b FROM analysed WHERE kept),
phr AS (SELECT g.query_id, x.doc_id, 0.5::DOUBLE * sum(len(list_intersect(list_transform(x.lc, lambda p: p + 1), y.lc))) AS phrase
        FROM big g JOIN post x ON x.term = g.a JOIN post y ON y.term = g.b AND y.doc_id = x.doc_id GROUP BY 1, 2),
found AS (SELECT d.query_id, d.doc_id, dot, length, coalesce(phrase, 0) AS phrase, coalesce(CASE WHEN length * norm > 0 THEN dot * dot / (length * norm) END, 0) AS vsm
          FROM dots d JOIN len l ON l.query_id = d.query_id JOIN norms n ON n.doc_id = d.doc_id LEFT JOIN phr p ON p.query_id = d.query_id AND p.doc_id = d.doc_id)"""

_CUR = f"""
cur AS (
  SELECT id, title, redirect, links, abstract_end, categories, {_TARGET.format(x='redirect')} AS t FROM pages WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY edited_at DESC NULLS LAST, loaded_at DESC NULLS LAST, title DESC NULLS LAST, redirect DESC NULLS LAST) = 1)"""
_RESOLVED = f"""{_CUR},
named AS (SELECT title, min(id) AS target FROM cur WHERE title IS NOT NULL GROUP BY 1),
way AS (
  SELECT id AS root, id FROM cur WHERE t IS NULL
  UNION ALL
  SELECT w.root, c.id FROM way w JOIN named n ON n.target = w.id JOIN cur c ON c.t = n.title),
resolved AS (SELECT c.id, w.root AS resolved_id FROM cur c LEFT JOIN way w ON w.id = c.id)"""
_EDGES = f"""{_RESOLVED},
raw_links AS (SELECT DISTINCT id AS src, {_TARGET.format(x='l')} AS t FROM (SELECT id, unnest(links) AS l FROM cur WHERE t IS NULL)),
graph AS (SELECT DISTINCT src, resolved_id AS dst FROM raw_links l JOIN named n ON n.title = l.t JOIN resolved r ON r.id = n.target WHERE resolved_id IS NOT NULL),
deg AS (SELECT src, count(*) AS out_degree FROM graph GROUP BY 1),
nodes AS (SELECT id AS doc_id, (SELECT count(*) FROM cur WHERE t IS NULL)::DOUBLE AS n FROM cur WHERE t IS NULL)"""


def _rank_steps(steps: int, kept: str) -> str:
    out = [f"{_EDGES},\nr0 AS (SELECT doc_id, n, 1.0::DOUBLE / n AS rank FROM nodes)"]
    for k in range(1, steps + 1):
        p = f"r{k - 1}"
        out.append(f"""f{k} AS (SELECT dst, sum(rank / out_degree) AS flow FROM graph g JOIN deg d ON d.src = g.src JOIN {p} ON {p}.doc_id = g.src GROUP BY 1),
d{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM {p} WHERE doc_id NOT IN (SELECT src FROM deg)),
r{k} AS (SELECT doc_id, n, 0.85::DOUBLE * (coalesce(flow, 0) + lost / n) + 0.15::DOUBLE / n * {kept} AS rank FROM {p} LEFT JOIN f{k} ON dst = doc_id, d{k})""")
    return ",\n".join(out)


_HINTS = f"""{_rank_steps(2, 'rank')},
hints AS (SELECT c.id, c.title, coalesce(k.rank, -1) AS raw, round(coalesce(k.rank, -1), 12) AS rank FROM cur c LEFT JOIN resolved r ON r.id = c.id LEFT JOIN r2 k ON k.doc_id = r.resolved_id)"""


def _complete(q: str) -> str:
    n = len(q)
    return f"""
WITH RECURSIVE {_HINTS},
long AS (SELECT *, lower(substr(title, 1, {n})) = {_quote(q)} AS pre, levenshtein(lower(substr(title, 1, {n})), {_quote(q)}) AS dist FROM hints WHERE length(title) >= {n}),
least AS (SELECT least({n}, min(dist)) AS m, min(dist) AS d FROM long WHERE NOT pre),
tiers AS (SELECT long.*, CASE WHEN pre AND length(title) = {n} THEN 0 WHEN pre THEN 1 ELSE 2 END AS tier FROM long, least WHERE pre OR (dist = d AND m < {int(0.8 * n)}))
SELECT id, title, CAST(row_number() OVER (ORDER BY tier, rank DESC, id) AS INTEGER) AS place FROM tiers QUALIFY place <= 6"""


def _wildcard(q: str) -> str:
    import re

    body = "".join({"*": r"[^\-\s]*", "?": r"[^\-\s]"}.get(c, re.escape(c)) for c in q)
    pattern = rf"(?i)\b{body}\b|\b{body}-|-{body}\b|-{body}-"
    return f"""
WITH {_CUR}
SELECT id, title, CAST(levenshtein(lower(title), {_quote(q)}) AS INTEGER) AS distance, CAST(row_number() OVER (ORDER BY levenshtein(lower(title), {_quote(q)}), id) AS INTEGER) AS place
FROM cur WHERE regexp_matches(title, {_quote(pattern)}) QUALIFY place <= 20"""


_CATS = f"""{_CUR},
ct AS (SELECT id AS doc_id, list_filter(string_split(lower(array_to_string(list_filter(coalesce(categories, []), lambda c: c IS NOT NULL), ' ')), ' '),
       lambda w: w <> '' AND length(w) <= {MAX_EN} AND NOT list_contains({_STOP}, w)) AS t FROM cur),
cpost AS (SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM ct) GROUP BY 1, 2),
cterms AS (SELECT term, round(log10((SELECT count(*) FROM ct WHERE len(t) > 0)::DOUBLE / count(*)), 4) AS idf FROM cpost GROUP BY 1),
cw AS (SELECT p.term, doc_id, n, round(round(1 + log10(n), 4) * idf, 4) AS tf_idf FROM cpost p JOIN cterms c ON c.term = p.term),
cn AS (SELECT doc_id, sqrt(sum(tf_idf * tf_idf)) AS norm FROM cw GROUP BY 1)"""

_TEXTS = "texts AS (SELECT page_id AS id, arg_min({'url': url, 'title': title, 'text': text}, doc_id) AS r FROM documents WHERE page_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"
_STRIP = r"regexp_replace({x}, '^(?s:.*?)\b[^\n]*\n\n', '')"
_HITS = "hits AS (SELECT query_id, doc_id, coalesce(max(tf_idf), 0) AS s FROM query_hits WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)"

_FIRST = "coalesce(list_position(list_transform({a}, lambda x: {c}), true), 0)"
_WIKI = rf"""
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, {_FIRST.format(a='l', c="starts_with(x, '==')")} AS h, {_FIRST.format(a='l', c="contains(x, '{{Infobox') AND NOT starts_with(x, '[[Category')")} AS b FROM l0),
l2 AS (SELECT *, CASE WHEN h > 0 THEN h - 1 ELSE len(l) END AS e, CASE WHEN b > 0 THEN {_FIRST.format(a='l[b:]', c="x = '}}'")} ELSE 0 END AS c FROM l1),
l3 AS (SELECT *, CASE WHEN b = 0 THEN 1 WHEN c = 0 THEN len(l) + 1 ELSE b + c - 1 END AS s FROM l2),
l4 AS (SELECT doc_id, l, list_filter(CASE WHEN s > e THEN [] ELSE l[s:e] END, lambda x: x <> '' AND NOT starts_with(x, '[[Category')) AS lead FROM l3),
l5 AS (SELECT *, {_FIRST.format(a='lead', c=r"regexp_matches(x, '^(?:\p{L}|'''''')')")} AS o FROM l4),
l6 AS (SELECT *, list_filter(CASE WHEN o > 0 THEN lead[o:] ELSE [] END, lambda x: NOT regexp_full_match(x, '<!--.*?-->') AND NOT regexp_full_match(x, '\{{\{{.*?\}}\}}')) AS m FROM l5),
l7 AS (SELECT *, array_to_string(list_transform(m, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z{{\[(]') THEN chr(10) || x ELSE x END), '') AS paras FROM l6)"""

def _simplify(pairs: dict[str, str], kept: list[str] = ()) -> str:
    text = "text"
    for word in kept:
        text = f"replace({text}, {_quote(word)}, {_quote(''.join(KEPT_SIGNS.get(c, c) for c in word))})"
    pairs = pairs | ({v: k for k, v in KEPT_SIGNS.items()} if kept else {})
    return f"""
WITH s AS (SELECT doc_id, regexp_replace(translate({text}, {_quote(''.join(pairs))}, {_quote(''.join(pairs.values()))}), '[\\n\\t]', '', 'g') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(s) AS INTEGER) AS chars, md5(s) AS digest FROM s"""


SQL = {
    "tokenize_en": f"WITH {_DOCS} SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens, md5(array_to_string(t, ' ')) AS digest FROM docs",
    "abstract_slice": f"""
WITH {_CUR} SELECT doc_id, array_to_string(list_slice({_LINES.format(x='text')}, 2, CASE WHEN abstract_end >= 1 THEN abstract_end + 1 ELSE 4 END), chr(10)) AS abstract
FROM documents d JOIN cur c ON c.id = d.page_id WHERE text IS NOT NULL""",
    "postings_build": f"WITH {_POSTINGS} SELECT term, doc_id, array_to_string(lc, ',') AS positions, CAST(n AS INTEGER) AS n FROM post",
    "doc_freq_idf": f"WITH {_POSTINGS} SELECT term, df, idf FROM terms_",
    "tfidf_weights": f"WITH {_POSTINGS} SELECT term, doc_id, tf, tf_idf FROM weighted",
    "doc_norms": f"WITH {_POSTINGS} SELECT doc_id, round(norm, 4) AS norm FROM norms",
    "vocab_stats": f"WITH {_POSTINGS} SELECT count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS doc_ids, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS positions FROM post",
    "stopword_case": f"WITH {_POSTINGS} SELECT term, count(*) AS df FROM post WHERE list_contains({_STOP}, term) GROUP BY 1",
    "query_terms": f"""
WITH {_POSTINGS}, {_ANALYSED}
SELECT query_id, coalesce(string_agg(term, ' ' ORDER BY place) FILTER (WHERE kept), '') AS kept_terms, coalesce(string_agg(term, ' ' ORDER BY place) FILTER (WHERE NOT kept), '') AS dropped FROM analysed GROUP BY 1""",
    "or_candidates": f"WITH {_FOUND} SELECT query_id, doc_id FROM found",
    "phrase_score": f"WITH {_FOUND} SELECT query_id, doc_id, phrase FROM found WHERE phrase > 0",
    "vsm_topk": f"WITH {_FOUND} SELECT query_id, doc_id, round(vsm, 6) AS vsm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(vsm, 6) DESC, doc_id) AS INTEGER) AS place FROM found QUALIFY place <= 10",
    "combined_search": f"""
WITH RECURSIVE {_FOUND}, {_rank_steps(3, 'rank')},
scored AS (SELECT query_id, f.doc_id, vsm + 10000 * coalesce(k.rank, 0) + phrase AS score FROM found f LEFT JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN r3 k ON k.doc_id = d.page_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS place FROM scored QUALIFY place <= 6""",
    "exact_title": f"WITH {_CUR} SELECT a.id AS query_id, min(b.id) AS id FROM cur a JOIN cur b ON lower(b.title) = lower(upper(a.title)) WHERE lower(upper(a.title)) = lower(a.title) GROUP BY 1",
    "title_promotion": f"""
WITH {_HITS}, {_CUR},
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS place FROM hits QUALIFY place <= 6),
asked AS (SELECT query_id, lower(upper(arg_max(title, doc_id))) AS q FROM hits JOIN cur ON cur.id = hits.doc_id WHERE title IS NOT NULL GROUP BY 1),
first AS (SELECT query_id, min(cur.id) AS id FROM asked JOIN cur ON lower(title) = q GROUP BY 1),
both_ AS (SELECT query_id, id AS doc_id, 0 AS place FROM first UNION ALL SELECT t.query_id, t.doc_id, t.place FROM top t LEFT JOIN first f ON f.query_id = t.query_id WHERE f.id IS NULL OR t.doc_id <> f.id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS INTEGER) AS place FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY both_.place, doc_id) <= 6""",
    "suggestion_ranks": f"WITH RECURSIVE {_HINTS} SELECT id, round(raw, 10) AS rank FROM hints",
    "redirect_resolve": f"WITH RECURSIVE {_RESOLVED} SELECT id, resolved_id FROM resolved",
    "link_edges": f"WITH RECURSIVE {_EDGES} SELECT src, dst FROM graph",
    "out_degree": f"WITH RECURSIVE {_EDGES} SELECT src, out_degree FROM deg",
    "pagerank_ref_5": f"WITH RECURSIVE {_rank_steps(5, 'rank')} SELECT doc_id, round(rank, 10) AS rank FROM r5",
    "pagerank_std_5": f"WITH RECURSIVE {_rank_steps(5, '1')} SELECT doc_id, round(rank, 10) AS rank FROM r5",
    "category_index": f"WITH {_CATS} SELECT term, doc_id, CAST(n AS INTEGER) AS n, tf_idf FROM cw",
    "recommend_related": f"""
WITH {_CATS},
own AS (SELECT doc_id, term, tf_idf AS v FROM cw WHERE doc_id % 20 = 0),
ol AS (SELECT doc_id, sqrt(sum(v * v)) AS length FROM own GROUP BY 1),
dots AS (SELECT o.doc_id, w.doc_id AS related_id, sum(v * tf_idf) AS dot FROM own o JOIN cw w ON w.term = o.term AND w.doc_id <> o.doc_id GROUP BY 1, 2),
cosines AS (SELECT d.doc_id, related_id, coalesce(CASE WHEN length * norm > 0 THEN dot / (length * norm) END, 0) AS cosine FROM dots d JOIN ol ON ol.doc_id = d.doc_id JOIN cn ON cn.doc_id = related_id)
SELECT doc_id, related_id, round(cosine, 6) AS cosine, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, related_id) AS INTEGER) AS place FROM cosines QUALIFY place <= 5""",
    "find_doc": f"""
WITH RECURSIVE {_RESOLVED}, {_TEXTS}
SELECT c.id AS doc_id, r.resolved_id AS id, CASE WHEN r.resolved_id IS NULL THEN '' ELSE coalesce(x.r.title, p.title) END AS title,
  CASE WHEN r.resolved_id IS NULL THEN '' ELSE coalesce(x.r.url, 'https://en.wikipedia.org/wiki?curid=' || r.resolved_id) END AS url,
  CAST(length(coalesce({_STRIP.format(x='x.r.text')}, '')) AS INTEGER) AS chars, CASE WHEN c.t IS NOT NULL THEN c.title ELSE '' END AS redirect_from, r.resolved_id IS NOT NULL AS page_exist
FROM cur c JOIN resolved r ON r.id = c.id LEFT JOIN cur p ON p.id = r.resolved_id LEFT JOIN texts x ON x.id = r.resolved_id""",
    "find_article": f"""
WITH {_CUR}, {_TEXTS}
SELECT i.id, coalesce(x.r.title, c.title) AS title, x.id IS NOT NULL AS has_text FROM (SELECT DISTINCT id FROM titles WHERE id IS NOT NULL) i LEFT JOIN texts x ON x.id = i.id LEFT JOIN cur c ON c.id = i.id
WHERE x.id IS NOT NULL OR c.title IS NOT NULL""",
    "title_lookup": """
WITH m AS (SELECT title, id FROM pages WHERE title IS NOT NULL AND id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY title ORDER BY edited_at DESC NULLS LAST, loaded_at DESC NULLS LAST, id DESC) = 1)
SELECT t.title, m.id FROM (SELECT DISTINCT title FROM titles WHERE title IS NOT NULL) t JOIN m ON m.title = t.title""",
    "links_of": "SELECT src AS id, array_to_string(list_sort(list_distinct(list(dst))), ',') AS links FROM edges WHERE dst IS NOT NULL AND src IS NOT NULL GROUP BY 1",
    "index_repair": """
WITH first AS (SELECT term, df, idf FROM terms WHERE term IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY term ORDER BY coalesce(df, 4611686018427387904), coalesce(idf, 1e300)) = 1)
SELECT term, df, idf, row_number() OVER (ORDER BY term) - 1 AS wi FROM first""",
    "wikitext_fields": rf"""
WITH {_WIKI}
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(paras, '<ref.*?</ref>', '', 'g'), '\[\[.*?\]\]?'), lambda x: split_part(split_part(regexp_replace(x, '\[\[|\]\]', '', 'g'), '|', 1), '#', 1)), chr(10)) AS links,
  CASE WHEN len(lead) > 0 THEN CAST(len(string_split(paras, chr(10))) AS INTEGER) ELSE 0 END AS abstract_end,
  array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '[[Category')), lambda x: regexp_split_to_array(x, ':|\]\]|\|')[2]), chr(10)) AS categories
FROM l7""",
    "xml_round_trip": rf"""
WITH {_CUR},
shown AS (SELECT *, array_to_string(list_filter(list_transform(coalesce(links, []), lambda x: {_TARGET.format(x='x')}), lambda x: x IS NOT NULL AND NOT regexp_matches(x, '[\[\]{{}}<>\n]')), chr(10)) AS seen, coalesce(redirect, '') = '' AS plain FROM cur)
SELECT id, title, t AS redirect, CASE WHEN plain THEN seen ELSE '' END AS links, CASE WHEN plain THEN 2 ELSE 0 END AS abstract_end, CASE WHEN plain THEN 'Pages,Id ' || id ELSE '' END AS categories
FROM shown WHERE title IS NOT NULL AND id % 3 <> 0 AND NOT regexp_matches(title, 'Wikipedia:|MediaWiki:|Help:')""",
    "json_round_trip": "SELECT doc_id AS id, url, title, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "posting_fetch": r"""
SELECT term, doc_id, CAST(max(n) AS INTEGER) AS n FROM (SELECT nullif(lower(regexp_replace(term, '^\s+|\s+$', '', 'g')), '') AS term, doc_id, len(lc) AS n FROM postings)
WHERE term IN ('the', 'located', 'village', 'nothing') AND doc_id IS NOT NULL AND n > 0 GROUP BY 1, 2""",
    "namespace_filter": f"""
WITH {_CUR} SELECT id, CASE WHEN regexp_matches(upper(left(title, 1)), '^[A-Z]$') THEN upper(left(title, 1)) ELSE 'other' END AS shard, CASE WHEN length(title) <= 20 THEN CAST(length(title) AS VARCHAR) ELSE 'other' END AS shard_zh
FROM cur WHERE title IS NOT NULL AND NOT regexp_matches(title, 'Wikipedia:|MediaWiki:|Help:') AND title IS DISTINCT FROM t""",
    "simplify": _simplify(T2S),
    "simplify_full": _simplify(simplified(), KEPT_WORDS),
    "snippets": f"SELECT doc_id, md5(substr({_STRIP.format(x='text')}, 1, 200)) AS digest FROM documents WHERE text IS NOT NULL",
    "result_page": f"""
WITH {_HITS}, top AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS place, count(*) OVER () // 10 + 1 AS pages FROM hits WHERE query_id = 1)
SELECT doc_id, CAST(place AS INTEGER) AS place, pages FROM top WHERE place BETWEEN 11 AND 20""",
    "result_pages": f"""
WITH {_HITS}, placed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS place, count(*) OVER (PARTITION BY query_id) // 10 + 1 AS pages FROM hits)
SELECT query_id, CAST(ceil(place / 10.0) AS INTEGER) AS page, doc_id, CAST(place AS INTEGER) AS place, pages FROM placed""",
    "plain_paragraphs": r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '<ref[^>]*/>|<ref.*?</ref>|\{\{[^{}]*\}\}|</?[A-Za-z][^<>]*>|''{2,}', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]', '\1', 'g'), '\([\s,;]*\)', '', 'g') AS x FROM a),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '([(,])\s*,+', '\1', 'g'), ' {2,}', ' ', 'g')) AS x FROM b)
SELECT doc_id, CAST(length(x) AS INTEGER) AS chars, md5(x) AS digest FROM c""",
    "wildcard_star": _wildcard("m*riki"),
    "wildcard_qmark": _wildcard("?alley"),
}
# whole searches: the index is that of the texts of pages, documents are pages
_PAGE_DOCS = "FROM (SELECT x.id AS doc_id, x.r.text AS text FROM texts x JOIN cur c ON c.id = x.id))"
_A_TITLE = "(SELECT coalesce(upper(min(title)), '') FROM cur WHERE regexp_full_match(title, '[A-Za-z ]+'))"
_ENGINE = f"""{_rank_steps(2, 'rank')}, {_TEXTS}, {_FOUND}""".replace("FROM documents WHERE text IS NOT NULL)", _PAGE_DOCS).replace(_QUERIES, f"(SELECT * FROM {_QUERIES} UNION ALL SELECT {len(QUERIES)}, {_A_TITLE})") + f""",
asked AS (SELECT * FROM {_QUERIES} UNION ALL SELECT {len(QUERIES)}, {_A_TITLE}),
ranked AS (SELECT query_id, f.doc_id, round(vsm + 10000 * coalesce(k.rank, 0) + phrase, 9) AS score FROM found f LEFT JOIN r2 k ON k.doc_id = f.doc_id),
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM ranked QUALIFY place <= 6),
first AS (SELECT query_id, min(c.id) AS id FROM asked a JOIN cur c ON lower(c.title) = lower(a.query) GROUP BY 1),
both_ AS (SELECT query_id, id AS doc_id, 0 AS p FROM first UNION ALL SELECT t.query_id, t.doc_id, t.place FROM top t LEFT JOIN first f ON f.query_id = t.query_id WHERE f.id IS NULL OR f.id <> t.doc_id),
placed AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, doc_id) AS INTEGER) AS place FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, doc_id) <= 6)"""
_MAPPED = """m AS (SELECT title, id FROM pages WHERE title IS NOT NULL AND id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY title ORDER BY edited_at DESC NULLS LAST, loaded_at DESC NULLS LAST, id DESC) = 1)"""

SQL |= {
    "engine_search": f"""
WITH RECURSIVE {_ENGINE},
lost AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS dropped FROM analysed WHERE NOT kept GROUP BY 1)
SELECT p.query_id, p.place, p.doc_id, r.resolved_id AS id, CASE WHEN r.resolved_id IS NULL THEN '' ELSE coalesce(x.r.title, e.title) END AS title,
  CASE WHEN r.resolved_id IS NULL THEN '' ELSE coalesce(x.r.url, 'https://en.wikipedia.org/wiki?curid=' || r.resolved_id) END AS url,
  CAST(length(coalesce({_STRIP.format(x='x.r.text')}, '')) AS INTEGER) AS chars, CASE WHEN c.t IS NOT NULL THEN c.title ELSE '' END AS redirect_from, r.resolved_id IS NOT NULL AS page_exist, coalesce(l.dropped, '') AS dropped
FROM placed p JOIN cur c ON c.id = p.doc_id JOIN resolved r ON r.id = c.id LEFT JOIN cur e ON e.id = r.resolved_id LEFT JOIN texts x ON x.id = r.resolved_id LEFT JOIN lost l ON l.query_id = p.query_id""",
    "engine_search_many": f"WITH RECURSIVE {_ENGINE} SELECT query_id, doc_id, place FROM placed",
    "engine_wildcard": f"WITH RECURSIVE {_RESOLVED}, w AS ({_wildcard('m*riki').split(_CUR, 1)[1]}) SELECT w.id AS doc_id, w.place, r.resolved_id IS NOT NULL AS page_exist FROM w JOIN resolved r ON r.id = w.id",
    "engine_complete": _complete(PREFIXES["complete_prefix"]),
    "completion_with_history": f"""
WITH h AS ({_complete(PREFIXES["complete_prefix"])}), all_ AS (SELECT title FROM h UNION SELECT * FROM (VALUES ('List of old queries'), ('list of 3')) v(title))
SELECT title FROM all_ WHERE title <> '' AND NOT regexp_matches(title, '[0-9]')""",
    "catalog_zones": "SELECT min(id) AS first, max(id) AS last, true AS apart FROM pages WHERE id IS NOT NULL HAVING count(*) > 0",
    "load_or_compute": r"""
WITH p AS (SELECT DISTINCT nullif(lower(regexp_replace(term, '^\s+|\s+$', '', 'g')), '') AS term, doc_id FROM postings WHERE doc_id IS NOT NULL AND len(lc) > 0)
SELECT term, count(*) AS df, 1 AS computed FROM p WHERE term IS NOT NULL GROUP BY 1""",
    "chunked_files": "SELECT CAST(count(*) AS BIGINT) AS rows, true AS bounded FROM documents HAVING count(*) > 0",
    "globbed_texts": "SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS chars FROM documents",
    "stop_words_file": f"SELECT term, count(*) AS n FROM (SELECT trim(lower(term)) AS term FROM postings) WHERE term <> '' AND NOT list_contains({_STOP}, term) GROUP BY 1",
    "title_shards": f"WITH {_MAPPED} SELECT title, id FROM m WHERE upper(left(title, 1)) = 'L'",
    "articles_by_title": f"""
WITH {_CUR}, {_TEXTS}, {_MAPPED}
SELECT m.title AS asked, m.id, coalesce(x.r.title, c.title) AS title, x.id IS NOT NULL AS has_text FROM (SELECT DISTINCT title FROM titles WHERE title IS NOT NULL) w JOIN m ON m.title = w.title LEFT JOIN texts x ON x.id = m.id LEFT JOIN cur c ON c.id = m.id
WHERE x.id IS NOT NULL OR c.title IS NOT NULL""",
    "links_by_title": f"""
WITH {_MAPPED}, l AS (SELECT src, array_to_string(list_sort(list_distinct(list(dst))), ',') AS links FROM edges WHERE dst IS NOT NULL AND src IS NOT NULL GROUP BY 1)
SELECT m.title, m.id, l.links FROM (SELECT DISTINCT title FROM titles WHERE title IS NOT NULL) w JOIN m ON m.title = w.title JOIN l ON l.src = m.id""",
}
SQL["catalog_categories"] = SQL["category_index"]
_FIRST_WANTED = "(SELECT min(doc_id) FROM cn WHERE doc_id % 20 = 0)"
SQL["engine_recommend"] = SQL["recommend_related"].replace("WHERE doc_id % 20 = 0", f"WHERE doc_id = {_FIRST_WANTED}")
SQL |= {name: _complete(q) for name, q in PREFIXES.items()}
