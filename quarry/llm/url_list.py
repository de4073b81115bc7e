"""The dated list that the URL filter's query applies, and the query's SQL for DuckDB."""

from __future__ import annotations

#: Category, and hosts or hosts with a path that it lists.
SOURCES = {
    "gambling": ["casino-win.example.com", "free-bets.example.com"],
    "pharmacy": ["cheap-pills.example.com"],
    "spam": ["spam-farm.example.org", "ththth.example.org", "m.tiontion.example.com/en"],
    "adult": ["ththon.example.com/de", "tionsh.example.net/es"],
    "copyright": ["blog.tionble.example.com", "thther.example.org"],
}
#: Exceptions: more specific keys that stay allowed while they are listed.
ALLOWED = ["blog.ththth.example.org/en", "m.thther.example.org"]


def entries() -> list[tuple[str, str, bool, bool, str]]:
    """key, category, allow, listed, day: each key is put on the list, taken off and put on again, on days of its own."""
    keyed = [(key, category, False) for category, keys in SOURCES.items() for key in keys]
    keyed += [(key, "exception", True) for key in ALLOWED]
    out = []
    for n, (key, category, allow) in enumerate(keyed):
        on, off, again = 1 + 7 * n % 60, 120 + 11 * n % 90, 240 + 13 * n % 100
        for listed, day in ((True, on), (False, off), (True, again)):
            out.append((key, category, allow, listed, day))
    return out


#: A capture's day of fetch, counted from 2024-01-01, follows its page's number.
DAYS = 365


def oracle() -> str:
    rows = ", ".join(
        f"('{key}', '{category}', {allow}, {listed}, TIMESTAMP '2024-01-01' + INTERVAL {day} DAY)"
        for key, category, allow, listed, day in entries()
    )
    return rf"""
WITH entries(key, category, allow, listed, since) AS (VALUES {rows}),
steps AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS valid_to FROM entries),
active AS (
  SELECT key, category, allow, since AS valid_from, valid_to,
         split_part(key, '/', 1) AS h, substr(key, length(split_part(key, '/', 1)) + 1) AS p
  FROM steps WHERE listed),
plain AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % {DAYS} AS INTEGER)) AS fetched,
         replace(regexp_replace(trim(url, ' ' || chr(9) || chr(10) || chr(13)), '[\t\n\r]', '', 'g'), '\', '/') AS u FROM pages),
cut AS (
  SELECT page_id, url, fetched, split_part(split_part(u, '#', 1), '?', 1) AS u, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:/') AS good FROM plain),
rest AS (SELECT page_id, url, fetched, CASE WHEN good THEN ltrim(substr(u, strpos(u, ':') + 1), '/') ELSE '' END AS r FROM cut),
captures AS (
  SELECT page_id, url, fetched, lower(rtrim(url_decode(regexp_replace(string_split(split_part(r, '/', 1), '@')[-1], ':[0-9]*$', '')), '.')) AS host,
    '/' || array_to_string(list_reduce(list_transform(list_filter(string_split(r, '/')[2:], lambda x: x <> ''), lambda x: [x]),
      lambda a, b: CASE replace(lower(b[1]), '%2e', '.') WHEN '.' THEN a WHEN '..' THEN a[:-2] ELSE list_concat(a, b) END, CAST([] AS VARCHAR[])), '/') || '/' AS path
  FROM rest),
met AS (
  SELECT c.page_id, a.key, a.category, a.allow,
         row_number() OVER (PARTITION BY c.page_id ORDER BY
           (length(a.p) - length(replace(a.p, '/', ''))) * 1000 + length(a.h) DESC, a.key DESC) AS rn,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN active a
    ON (c.host = a.h OR ends_with(c.host, '.' || a.h)) AND (a.p = '' OR starts_with(c.path, a.p || '/'))
   AND c.fetched >= a.valid_from AND (a.valid_to IS NULL OR c.fetched < a.valid_to))
SELECT c.page_id, c.url, c.fetched, coalesce(m.n, 0) AS n_active, m.key AS entry, m.category,
       m.key IS NOT NULL AND NOT m.allow AS blocked
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND m.rn = 1
"""
