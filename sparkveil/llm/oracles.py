"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s
), f AS (
  SELECT *, row_number() OVER o AS place,
         (total - (sum(lim) OVER (o ROWS UNBOUNDED PRECEDING) - lim)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY lim / w, source NULLS LAST)
), c AS (
  SELECT min(place) AS cut FROM f WHERE level * w <= lim
), t AS (
  SELECT f.source, source_size, CASE WHEN place >= cut THEN (SELECT level FROM f, c WHERE place = cut) * w ELSE lim END AS target,
         ('0x' || substr(md5('mix-1|' || coalesce('s' || f.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM f, c
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (floor(u + target / source_size * k) - floor(u + target / source_size * (k - 1)))::BIGINT * size ELSE 0 END AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

OP10 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         lower(split_part(url, '://', 1)) AS scheme, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM p
), n AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN scheme || '://' || host || path || query END AS node FROM h
), tags AS (
  SELECT node, scheme, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link\b[^>]*\bcanonical\b|meta\b[^>]*\brefresh\b)[^>]*>')) AS tag
  FROM n WHERE node IS NOT NULL
), goes AS (
  SELECT *, replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical[\s/>])') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    ELSE '' END, '&amp;', '&') AS goto
  FROM tags
), full_to AS (
  SELECT node, CASE
    WHEN starts_with(goto, '#') THEN NULL
    WHEN regexp_matches(goto, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goto
    WHEN regexp_matches(goto, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(goto, '//') THEN scheme || ':' || goto
    WHEN starts_with(goto, '/') THEN scheme || '://' || host || goto
    WHEN starts_with(goto, '?') THEN scheme || '://' || host || path || goto
    ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || goto END AS goto
  FROM goes WHERE goto <> ''
), cut AS (
  SELECT node, substr(goto, strpos(goto, '://') + 3) AS rest, lower(split_part(goto, '://', 1)) AS scheme FROM full_to WHERE goto IS NOT NULL
), parsed AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), edges AS (
  SELECT DISTINCT node AS a, scheme || '://' || translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || CASE WHEN regexp_matches(path, '/\.{1,2}(/|\z)') THEN '/' || array_to_string(list_concat(
              list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(path, '/')[2:], lambda s: [s])),
                          lambda done, s: CASE WHEN s[1] = '..' THEN done[1:len(done) - 1] WHEN s[1] = '.' THEN done ELSE list_concat(done, s) END),
              CASE WHEN regexp_matches(path, '/\.{1,2}\z') THEN [''] ELSE []::VARCHAR[] END), '/') ELSE path END
         || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS b
  FROM parsed
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), places AS (
  SELECT node, host, path FROM n
  UNION SELECT b, regexp_extract(b, '://([^/?#]*)', 1), regexp_extract(b, '://[^/?#]*([^?#]*)', 1) FROM both_ways
), fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM places), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), reach(a, b) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), handed AS (
  SELECT DISTINCT reach.a AS node FROM reach JOIN places ON places.node = reach.b JOIN fits USING (host, path) WHERE fits.verdict = 'block'
)
SELECT page_id, n.host, n.path, rule, coalesce(verdict, CASE WHEN handed.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN fits USING (host, path) LEFT JOIN handed USING (node)
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), c AS (
  SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM g WHERE len(sh) > 0 GROUP BY list_sort(sh)
), e AS (
  SELECT rep, len(sh) AS n, unnest(sh) AS s FROM c
), f AS (
  SELECT * FROM e WHERE s IN (SELECT s FROM e GROUP BY s HAVING count(*) > 1)
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM f a JOIN f b ON a.s = b.s AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT rep, rep FROM c UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), comp AS (
  SELECT a AS rep, min(b) AS component FROM reach GROUP BY a
)
SELECT g.doc_id, len(g.sh)::BIGINT AS n_shingles, coalesce(component, g.doc_id) AS component_id
FROM g LEFT JOIN c ON list_sort(g.sh) = c.sh AND len(g.sh) > 0 LEFT JOIN comp ON c.rep = comp.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op5_mix_sources": OP5, "op6_ngram_join": OP6, "op7_top_k": OP7, "op10_url_filter": OP10}
