"""SQL twins of the queries that SQL can express.

The others learn a model, hash with functions that SQL lacks, or run an external
vocabulary; the tests hold them against plain versions.
"""

from __future__ import annotations

# Written out once more, not taken from the queries.
_HOST_RULES = """('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')"""
_NAMES = """'casino-win', 'free-casino', 'online-casino', 'cheap-pills', 'online-pills', 'free-bets', 'best-bets',
  'spam-farm', 'link-farm', 'adult-chat', 'payday-loans', 'replica-watches'"""

ORACLES: dict[str, str] = {
    "op10_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://')
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/]*(.*)$', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {_HOST_RULES}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN list_has_any(string_split(host, '.'), [{_NAMES}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (page_id)""",
}
