"""The same results as plain SQL over the given tables, for DuckDB, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op4_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w, true), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

_HALVES = """[
  (m, 0, left(line, m // 2)), (m, 1, right(line, m - m // 2)),
  (m - 1, 0, left(line, (m - 1) // 2)), (m - 1, 1, right(line, m - 1 - (m - 1) // 2))]"""
SQL["op8_line_dedup"] = f"""
WITH pieces AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM pieces
), firsts AS (
  SELECT line, length(line) AS m, min((doc_id, line_no)) AS place FROM l WHERE line <> '' GROUP BY line
), halves AS (SELECT line, m, place, unnest({_HALVES}) AS half FROM firsts WHERE m >= 20
), pairs AS (
  SELECT DISTINCT a.line AS earlier, a.m AS m0, b.line, b.m AS m1
  FROM halves a JOIN halves b ON a.half = b.half AND a.place < b.place AND abs(a.m - b.m) <= 1
), near AS (
  SELECT DISTINCT line FROM pairs WHERE len(list_filter(range(1, greatest(m0, m1) + 1), lambda i: CASE
    WHEN m0 = m1 THEN left(earlier, i - 1) = left(line, i - 1) AND substr(earlier, i + 1) = substr(line, i + 1)
    WHEN m0 > m1 THEN left(earlier, i - 1) || substr(earlier, i + 1) = line
    ELSE left(line, i - 1) || substr(line, i + 1) = earlier END)) > 0
), judged AS (
  SELECT l.doc_id, l.line_no, l.raw, coalesce((l.doc_id, l.line_no) <> f.place OR n.line IS NOT NULL, false) AS gone
  FROM l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""

# The given pages hold no canonical links or redirects, so that the SQL has rules only;
# links are tested on a fixture.
SQL["op9_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), a AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS address FROM p
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), j AS (
  SELECT a.*, rule_host || rule_path AS rule, verdict
  FROM a LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id, host, path
    ORDER BY length(rule_host || rule_path) DESC, verdict, rule_host || rule_path) = 1
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN address IS NOT NULL THEN min(verdict) OVER (PARTITION BY address) END, 'allow') AS verdict,
  address AS alias_group
FROM j
"""
