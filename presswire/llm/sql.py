"""DuckDB SQL with the rows of this subpackage's queries, for tables small enough to compare all pairs."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Smallest ids that links ``e`` (a, b: row numbers, both ways) reach.
_REACH = "reach AS (SELECT a AS r, b AS m FROM e UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.m = e.a)"

OP2 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
e AS (SELECT a, b, k = p.n AND k = q.n AS equal FROM shared JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
{_REACH},
c AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.m GROUP BY reach.r),
l AS (SELECT a AS r, count(*) AS links, count(*) FILTER (equal) AS copies FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, CAST(1 + coalesce(copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""

OP8 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT r, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT p.r AS a, q.r AS b FROM u p JOIN u q ON p.r <> q.r AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
{_REACH},
c AS (SELECT reach.r, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.m GROUP BY reach.r),
l AS (SELECT a AS r, count(*) AS links FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""

QUALITY_BASE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d))),
c AS (SELECT r, count(*) AS covered FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM g WHERE k > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN c USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""

LICENSE_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT r, i, w[i] || ' ' || coalesce(w[i + 1], '') AS two, w[i] || ' ' || coalesce(w[i + 1], '') || ' ' || coalesce(w[i + 2], '') AS three FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
p AS (SELECT r, i - 1 AS word, CASE WHEN two = 'cc by' THEN 'cc-by' WHEN three = 'general public license' THEN 'gpl' ELSE 'reserved' END AS label FROM i WHERE two = 'cc by' OR three IN ('general public license', 'all rights reserved')),
s AS (SELECT r, count(*) AS n, min(word) AS a, max(word) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN s USING (r)
"""
