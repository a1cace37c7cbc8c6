"""SQL that gives the rows of the operators SQL can express."""

LINE_DEDUP = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
flat AS (
  SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM docs),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM flat),
rolled AS (
  SELECT *, (h + 31 * COALESCE(LAG(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 1000003 AS r FROM hashed),
marked AS (
  SELECT *, CASE WHEN i >= 2 AND i < n - 1 AND r < LAG(r) OVER w AND r <= LEAD(r) OVER w THEN 1 ELSE 0 END AS opens
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, SUM(opens) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM marked),
chunks AS (
  SELECT doc_id, chunk, MIN(i) AS start, COUNT(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, chunk),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY body, size > 1 ORDER BY doc_id, start) AS k FROM chunks),
kept AS (
  SELECT doc_id, SUM(size) AS n_lines,
         COALESCE(SUM(size) FILTER (WHERE size > 1 AND k > 1), 0) AS n_removed,
         COALESCE(string_agg(body, chr(10) ORDER BY start) FILTER (WHERE size = 1 OR k = 1), '') AS body
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(body, '')) AS text_sha256
FROM docs AS d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""

DECONTAMINATE = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (
  SELECT doc_id, COALESCE(list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS w
  FROM lowered),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
wanted AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM items, UNNEST(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wanted),
grams AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS i, w FROM words, sizes WHERE len(w) >= size),
hits AS (
  SELECT g.doc_id, g.i, g.size, t.item_id
  FROM grams AS g JOIN wanted AS t ON t.size = g.size AND t.g = array_to_string(g.w[g.i : g.i + g.size - 1], ' ')),
covered AS (
  SELECT doc_id, COUNT(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated
FROM words AS d LEFT JOIN covered AS c ON c.doc_id = d.doc_id LEFT JOIN named AS n ON n.doc_id = d.doc_id
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         MIN(doc_id) OVER (PARTITION BY t) AS original
  FROM texts),
failing AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, COALESCE(doc_id > original, false) AS e
  FROM worded),
marks AS (
  SELECT doc_id, MAX(quality) FILTER (WHERE quality IN (0, 1)) AS quality, MAX(toxic) FILTER (WHERE toxic IN (0, 1)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rated AS (
  SELECT f.*, COALESCE(quality, 0) AS good, COALESCE(toxic, 0) AS bad,
         CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS n_failed
  FROM failing AS f LEFT JOIN marks AS m ON m.doc_id = f.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.f NOT IN (w.f, x.f, y.f, z.f) AND w.f NOT IN (x.f, y.f, z.f) AND x.f NOT IN (y.f, z.f) AND y.f <> z.f),
kinds AS (
  SELECT part, a, b, c, d, e, n_failed, COUNT(*) AS n, SUM(good) AS good, SUM(bad) AS bad
  FROM rated GROUP BY ALL),
steps AS (
  SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f, substr(filter_order, 1, s.step - 1) AS earlier
  FROM orders, generate_series(1, 5) AS s(step)),
judged AS (
  SELECT k.part, s.filter_order, s.step, s.f, k.n, k.good, k.bad, k.n_failed,
         (s.f = 'A' AND a) OR (s.f = 'B' AND b) OR (s.f = 'C' AND c) OR (s.f = 'D' AND d) OR (s.f = 'E' AND e) AS fails,
         (contains(earlier, 'A') AND a) OR (contains(earlier, 'B') AND b) OR (contains(earlier, 'C') AND c)
           OR (contains(earlier, 'D') AND d) OR (contains(earlier, 'E') AND e) AS gone
  FROM kinds AS k, steps AS s),
summed AS (
  SELECT part, filter_order, step, f,
         COALESCE(SUM(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept,
         COALESCE(SUM(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
         COALESCE(SUM(n) FILTER (WHERE gone AND fails), 0) AS redundant,
         COALESCE(SUM(n) FILTER (WHERE fails AND n_failed = 1), 0) AS unique_fails,
         COALESCE(SUM(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost,
         COALESCE(SUM(bad) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
