"""SQL for DuckDB of operators that compare whole tables."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(u, v) AS (SELECT k, k FROM vertices UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)"

_GRID = f"""WITH RECURSIVE vertices AS (SELECT vec_id AS k FROM embeddings),
good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH},
components AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components ON u = vec_id"""

_NEAR = rf"""WITH RECURSIVE vertices AS (SELECT doc_id AS k FROM documents),
worded AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * m >= 75 * (x.n + y.n - m)),
{_REACH},
components AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN components ON u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HITS = f"""WITH worded AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
    lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS place, unnest(list_transform(range(1, len(w) - n + 2),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x FROM worded JOIN lengths ON len(w) >= n),
found AS (SELECT doc_id, place, n, item FROM windows JOIN wanted USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_AUDIT = r"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END) ||
    (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > f.first THEN 'E' ELSE '' END) AS failed
  FROM worded d JOIN firsts f ON f.t = d.t LEFT JOIN marks m ON m.doc_id = d.doc_id),
grouped AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT l AS o FROM letters UNION ALL SELECT o || l FROM orders JOIN letters ON strpos(o, l) = 0),
steps AS (
  SELECT o AS filter_order, s AS step, substr(o, s, 1) AS l, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
cells AS (
  SELECT part, filter_order, step, l, n, good, toxic, failed, strpos(failed, l) > 0 AS here,
    length(translate(failed, earlier, '')) < length(failed) AS gone FROM grouped CROSS JOIN steps),
counted AS (
  SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = l), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM cells GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM counted"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT d.doc_id, line, place, c.k IS NOT NULL AND c.last <> d.doc_id AS gone FROM keyed d LEFT JOIN common c ON c.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""

_RETENTION = """WITH RECURSIVE bits AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
once AS (SELECT DISTINCT * FROM clicks),
ids AS (SELECT DISTINCT x FROM (SELECT click_id AS x FROM once UNION ALL SELECT client_id FROM once) WHERE x IS NOT NULL),
summed AS (
  SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(x AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: xor(c >> 8, t[CAST(xor(c & 255, d) AS INTEGER) + 1])), 4294967295) AS crc FROM ids, crcs),
known AS (
  SELECT client_id, ts, kind, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents, s.state
  FROM once c LEFT JOIN summed h ON h.x = c.click_id, (SELECT unnest([0, 1]) AS state) s
  WHERE ts IS NOT NULL AND client_id IS NOT NULL AND
    (s.state = 1 OR arrived_at + to_days(CAST(CASE WHEN h.crc % 3 = 0 THEN h.crc % 100 ELSE 0 END AS INTEGER)) < TIMESTAMP '2024-03-01 00:00:00')),
starts AS (SELECT state, client_id, min(ts) AS start FROM known WHERE kind = 'purchase' GROUP BY ALL),
cohorts AS (SELECT *, CAST(floor(floor(epoch_us(start) / 86400000000) / 3) AS BIGINT) AS cohort FROM starts),
moved AS (
  SELECT client_id, CASE WHEN count(*) = 2 AND min(cohort) <> max(cohort) THEN 1 ELSE 0 END AS moved FROM cohorts GROUP BY client_id),
facts AS (
  SELECT k.state, k.client_id, cohort, (epoch_us(ts) - epoch_us(start)) // 259200000000 AS period, sum(cents) AS cents
  FROM known k JOIN cohorts s ON s.state = k.state AND s.client_id = k.client_id WHERE ts >= start GROUP BY ALL),
cities AS (SELECT client_id, coalesce(min(city), '') AS city FROM clients GROUP BY client_id)
SELECT CAST(f.state AS INTEGER) AS state, coalesce(city, '') AS segment, cohort, CAST(period AS BIGINT) AS period, count(*) AS users,
  CAST(sum(h.crc) AS BIGINT) AS users_crc32, CAST(sum(m.moved) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM facts f JOIN moved m ON m.client_id = f.client_id JOIN summed h ON h.x = f.client_id LEFT JOIN cities c ON c.client_id = f.client_id
GROUP BY f.state, coalesce(city, ''), cohort, period"""

ORACLE = {
    "op1_grid_join": _GRID,
    "op7_decontaminate": _HITS,
    "op10_minhash": _NEAR,
    "op11_filter_audit": _AUDIT,
    "op12_line_dedup": _LINES,
    "op13_retention": _RETENTION,
}
