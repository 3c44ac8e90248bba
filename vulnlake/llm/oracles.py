"""DuckDB twins of the corpus queries that SQL can say; the numbers are those of the operators' modules."""

from __future__ import annotations

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM x) WHERE c > 1) GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length FROM base),
v AS (SELECT rid, lang, source, base_failed, unnest([{'m': 'symbols', 'v': symbols, 's': 30}, {'m': 'dup_lines', 'v': dup_lines, 's': 350}, {'m': 'repeats', 'v': repeats, 's': 300}, {'m': 'word_length', 'v': word_length, 's': 120}], recursive := true) FROM m),
b AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bin FROM v),
q AS (SELECT m, lang, source, grouping(lang, source) AS g, count(*) AS total, list_sort(list(bin)) AS bins FROM b WHERE NOT base_failed GROUP BY GROUPING SETS ((m, lang, source), (m, lang), (m))),
u AS (SELECT *, bins[CAST(ceil(total / 4) AS BIGINT)] AS lower, bins[CAST(ceil(3 * total / 4) AS BIGINT)] AS upper FROM q),
j AS (SELECT b.rid, b.m, b.v, b.s, CASE WHEN a.total >= 50 THEN [a.lower, a.upper] WHEN l.total >= 50 THEN [l.lower, l.upper] ELSE [e.lower, e.upper] END AS f
  FROM b LEFT JOIN u a ON a.g = 0 AND a.m = b.m AND a.lang = b.lang AND a.source = b.source LEFT JOIN u l ON l.g = 1 AND l.m = b.m AND l.lang = b.lang LEFT JOIN u e ON e.g = 3 AND e.m = b.m),
o AS (SELECT rid, coalesce(bool_or(v > f[2] + 4 * (f[2] - f[1]) + s OR (m = 'word_length' AND v < f[1] - 4 * (f[2] - f[1]) - s)), false) AS out FROM j GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT out AS kept FROM m JOIN o USING (rid)
"""

#: Blocks of 512 words; the tree over shards moves no words between documents, so it isn't needed here.
MIX = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('s' || source, 'n') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS o FROM documents),
n AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY key)),
c AS (SELECT *, w * (sum(s) OVER () - coalesce(sum(3 * s) OVER b, 0)) >= 3 * s * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS stopped FROM n
  WINDOW b AS (ORDER BY 3 * s / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, s, CASE WHEN stopped THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * (sum(s) OVER () - coalesce(sum(3 * s) FILTER (WHERE stopped) OVER (), 0)) AS DOUBLE) / sum(w) FILTER (WHERE NOT stopped) OVER () END AS target FROM c),
p AS (SELECT key, s, target, CAST(floor(target + 0.5) AS BIGINT) // greatest(s, 1) AS rounds, CAST(floor(target + 0.5) AS BIGINT) % greatest(s, 1) AS rest FROM t),
k AS (SELECT key, s, b, rest, row_number() OVER (PARTITION BY key ORDER BY (b + 1) * 512 > s, substr(md5(key || ':' || rounds || ':' || b), 1, 16), b) - 1 AS place
  FROM (SELECT *, unnest(range((s + 511) // 512)) AS b FROM p WHERE rest > 0)),
r AS (SELECT key, b, least(512, s - b * 512, rest - place * 512) AS words FROM k WHERE place * 512 < rest),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
y AS (SELECT rid, key, start, size, unnest(range(CAST(start // 512 AS BIGINT), CAST((start + size - 1) // 512 + 1 AS BIGINT))) AS b FROM x WHERE size > 0),
e AS (SELECT rid, sum(greatest(0, least(start + size, y.b * 512 + words) - greatest(start, y.b * 512))) AS extra FROM y JOIN r USING (key, b) GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(rounds * size + coalesce(extra, 0) AS BIGINT) AS taken FROM d JOIN p USING (key) LEFT JOIN e USING (rid)
"""


_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
#: CRC-32 of `s`, of characters below U+0800, with the table of bytes in column `t`.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
    "ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
)

SPELLING = rf"""
WITH RECURSIVE k AS MATERIALIZED (SELECT {_TABLE} AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM o, k),
w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(h.n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT * FROM (SELECT x.word, w.word AS near, w.n FROM x JOIN w ON x.key = w.word UNION ALL SELECT w.word, x.word, x.n FROM x JOIN w ON x.key = w.word
  UNION ALL SELECT a.word, b.word, b.n FROM x a JOIN x b ON a.i = b.i AND a.key = b.key AND a.word <> b.word)),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, g.root FROM f JOIN g USING (word) JOIN f e ON e.word = g.root AND e.form IS NULL
"""

PREFIXES = rf"""
WITH k AS MATERIALIZED (SELECT {_TABLE} AS t),
t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM s, k),
l AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS top FROM c LEFT JOIN (SELECT conv_id, n FROM s) b ON b.conv_id = c.base),
r AS (SELECT l.conv_id, i + 1 AS depth, e FROM l JOIN t ON t.conv_id = l.base AND i < h UNION ALL SELECT conv_id, top + i - h + 1, e FROM l JOIN t USING (conv_id) WHERE i >= h),
a AS (SELECT conv_id, coalesce(list(e ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS path FROM l LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, path[1:d] AS path, d AS depth, len(path) = d AS last FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM a)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM m GROUP BY depth, path),
o AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
j AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
q AS (SELECT n.depth AS d, n.path, (n_convs - 1) * coalesce(length(n.path[n.depth].text), 0) AS saved, n_children IS NULL AS leaf FROM n LEFT JOIN j USING (depth, path)),
u AS (SELECT depth, path[1:depth] AS path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS depth FROM q) GROUP BY ALL)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM o LEFT JOIN j USING (depth, path) JOIN u USING (depth, path)
"""
