"""SQL that the queries' SQL shares."""

CURRENT = """WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mtime DESC NULLS LAST) AS place FROM chunks WHERE id IS NOT NULL) WHERE place = 1
)"""
TOKENS = (
    CURRENT
    + r""", parts AS (
  SELECT id, doc_id, tree, 'body' AS field, 0 AS part, body AS text FROM cur
  UNION ALL SELECT id, doc_id, tree, 'path', 0, path FROM cur
  UNION ALL SELECT id, doc_id, tree, 'tags', 0, array_to_string(tags, ' ') FROM cur
  UNION ALL SELECT id, doc_id, tree, 'hierarchy', unnest(range(len(hierarchy))), unnest(hierarchy) FROM cur
), worded AS (
  SELECT id, doc_id, tree, field, part, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40) AS w FROM parts WHERE text IS NOT NULL
), tok AS (
  SELECT id, doc_id, tree, field, part * 100000 + i - 1 AS pos, w[i] AS term FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM worded)
), lens AS (SELECT id, field, sum(len(w)) AS len FROM worded GROUP BY id, field HAVING sum(len(w)) > 0),
total AS (SELECT count(*) AS n FROM cur),
avgs AS (SELECT field, sum(len) / (SELECT n FROM total)::DOUBLE AS avg_len FROM lens GROUP BY field),
post AS (SELECT field, term, id, doc_id, tree, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
scored AS (
  SELECT p.*, len, df, CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END
    * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s
  FROM post p JOIN dfs USING (field, term) JOIN lens USING (id, field) JOIN avgs USING (field)
)"""
)
