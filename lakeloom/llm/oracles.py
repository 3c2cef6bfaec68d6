"""DuckDB SQL by plain definition, for operators whose result SQL can state."""

from __future__ import annotations

from lakeloom.llm import licenses

#: op4: all pairs of documents that share a shingle, links by exact similarity, reachability by recursion.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * k >= 85 * (na + nb - k)), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS pos FROM sets UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.pos),
least AS (SELECT doc_id, min(pos) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

#: op10: every run of lines with 50 words and more, the first place of each, and what lies in another place of it.
LINE_DEDUP = r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
y AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM x),
z AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS c FROM y WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM z GROUP BY doc_id),
r AS (SELECT a.doc_id, a.i AS lo, b.i AS hi, md5(array_to_string(d.ls[a.i:b.i], chr(10))) AS k FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 JOIN d ON d.doc_id = a.doc_id),
f AS (SELECT k, min((doc_id, lo)) AS first FROM r GROUP BY k),
gone AS (SELECT DISTINCT z.doc_id, z.pos FROM r JOIN f USING (k) JOIN z ON z.doc_id = r.doc_id AND z.i BETWEEN r.lo AND r.hi WHERE (r.doc_id, r.lo) > f.first),
kept AS (SELECT y.doc_id, string_agg(y.line, chr(10) ORDER BY y.pos) FILTER (g.pos IS NULL) AS t, count(g.pos) AS n FROM y LEFT JOIN gone g USING (doc_id, pos) GROUP BY y.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, d.lang, d.source, CASE WHEN n > 0 THEN length(coalesce(t, '')) ELSE d.n_chars END AS n_chars, coalesce(n, 0) AS n_lines_dropped FROM documents d LEFT JOIN kept USING (doc_id)
"""

#: op6: targets in closed form (the level at which the first source isn't full), places by size, id and text, integers crossed.
MIX_SOURCES = r"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, md5(text) AS tie, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY none, name) - 1) % 3 + 1] AS w, 2 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / w, none, name)),
f AS (SELECT arg_min(level, (cap / w, level)) AS final FROM l WHERE level * w <= cap),
t AS (SELECT none, name, source_size, CASE WHEN final IS NULL THEN cap ELSE least(w * final, cap) END AS target FROM l CROSS JOIN f),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each, ('0x' || substr(md5((CASE WHEN none THEN '1' ELSE '0' END) || name || '|7'), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY none, name ORDER BY size, coalesce(doc_id, -1), tie NULLS FIRST) - 1 AS place FROM d JOIN t USING (none, name))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size > 0 THEN least(floor((place + 1) * each + u) - floor(place * each + u), ceil(each)) ELSE 0 END * size AS BIGINT) AS taken FROM r
"""


def license_scan() -> str:
    """op8: phrases by their words, notices by shared word k-grams on neighbouring diagonals, coverage by places of the notice."""
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    k, drift, cover = licenses.K, licenses.DRIFT, licenses.COVER
    notices = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in licenses.PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, {words('text')} AS ws FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) v(label, ph)),
b AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(ph)] = ph)) AS pos FROM d CROSS JOIN p),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label ORDER BY label) AS labels FROM b GROUP BY doc_id),
t AS (SELECT template, label, {words('text')} AS ws FROM (VALUES {notices}) v(template, label, text)),
tg AS (SELECT template, label, len(ws) AS t_words, unnest(range(len(ws) - {k - 1})) AS t_pos, unnest([ws[i:i + {k - 1}] for i in range(1, len(ws) - {k - 2})]) AS g FROM t),
dg AS (SELECT doc_id, unnest(range(len(ws) - {k - 1})) AS d_pos, unnest([ws[i:i + {k - 1}] for i in range(1, len(ws) - {k - 2})]) AS g FROM d WHERE len(ws) >= {k}),
hit AS (SELECT doc_id, template, label, t_words, t_pos, d_pos, d_pos - t_pos AS diagonal FROM dg JOIN tg USING (g)),
dia AS (SELECT DISTINCT doc_id, template, diagonal FROM hit),
cut AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {drift}, TRUE)::INT AS fresh FROM dia WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
ali AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS a FROM cut),
cov AS (SELECT doc_id, template, label, t_words, a, len(list_distinct(flatten(list(range(t_pos, t_pos + {k}))))) / t_words AS score, min(d_pos) AS lo, max(d_pos) AS hi FROM hit JOIN ali USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, t_words, a),
found AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS labels FROM cov WHERE score >= {cover} AND hi + {k} - lo <= 2 * t_words GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(base.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(found.score, 0)) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
