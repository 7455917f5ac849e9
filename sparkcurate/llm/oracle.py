"""The registered queries in plain SQL, for small tables: all pairs, recursion and whole windows."""

from __future__ import annotations

from sparkcurate.llm import licenses, mixing, urls

WORDS = r"'[^\x20\x09-\x0D]+'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _urls() -> str:
    host = lambda u: f"translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    path = lambda u: f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    address = lambda u: (
        f"CASE WHEN contains({u}, '://') THEN regexp_replace({host(u)}, ':(80|443)$', '') || regexp_replace({path(u)}, '/$', '') || "
        f"coalesce(nullif('?' || array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)=')), '&'), '?'), '') END"
    )
    rules = ", ".join(f"({text(v)}, {text(r)}, {text(r.split('/', 1)[0])}, {text('/' + r.split('/', 1)[1])})" for v, r in urls.RULES)
    return f"""
WITH RECURSIVE rules(verdict, rule, host, start) AS (VALUES {rules}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
found AS (
  SELECT url, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS t FROM tags
  WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
  UNION ALL SELECT url, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags
  WHERE regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
parts AS (SELECT url, t, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, {host('url')} AS host,
  coalesce(nullif(regexp_replace({path('url')}, '[^/]*$', ''), ''), '/') AS folder FROM found WHERE t <> ''),
target AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
  WHEN starts_with(t, '/') THEN scheme || '://' || host || t ELSE scheme || '://' || host || folder || t END AS t FROM parts),
links AS (SELECT {address('url')} AS a, {address('t')} AS b, t FROM target),
pairs AS (SELECT a, b FROM links WHERE b IS NOT NULL UNION SELECT b, a FROM links WHERE b IS NOT NULL),
reach AS (SELECT a AS node, a AS other FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
comp AS (SELECT node, min(md5(other)) AS c FROM reach GROUP BY node),
seen AS (SELECT {address('url')} AS node, url FROM pages UNION SELECT b, t FROM links),
ruled AS (SELECT url, arg_max(r.verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
  FROM (SELECT DISTINCT url FROM seen) s JOIN rules r ON ({host('url')} = r.host OR ends_with({host('url')}, '.' || r.host))
  AND starts_with({path('url')}, r.start) GROUP BY url),
said AS (SELECT coalesce(c, md5(node)) AS c, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
  FROM seen JOIN ruled USING (url) LEFT JOIN comp USING (node) GROUP BY ALL),
p AS (SELECT page_id, url, {address('url')} AS node FROM pages)
SELECT page_id, coalesce({host('p.url')}, '') AS host, coalesce({path('p.url')}, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(comp.c, md5(p.node)) AS alias_of
FROM p LEFT JOIN comp ON comp.node = p.node LEFT JOIN ruled r ON r.url = p.url LEFT JOIN said ON said.c = coalesce(comp.c, md5(p.node))"""


def _licenses() -> str:
    rules = ", ".join(
        f"({i}, {text(s.keyword)}, {text(s.pattern)}, {s.priority}, {text(s.label)}, {s.weight}::DOUBLE)" for i, s in enumerate(licenses.signatures())
    )
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS start, {text(label)} AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE "
        + " AND ".join(f"ws[i + {k}] = {text(word)}" for k, word in enumerate(phrase))
        for phrase, label in licenses.PHRASES
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS ws FROM documents),
places AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n, min(start) AS first, max(start) AS last FROM places GROUP BY 1),
rules(rule, keyword, pattern, priority, label, weight) AS (VALUES {rules}),
tried AS (SELECT doc_id, ' ' || array_to_string(ws, '  ') || ' ' AS t, r.* FROM w JOIN rules r ON list_contains(ws, r.keyword)),
hits AS (SELECT doc_id, rule, priority, label, weight, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM tried),
spans AS (SELECT doc_id, rule, priority, label, weight, len(m[i]) AS size,
  list_sum(list_transform(g[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS b
  FROM hits, unnest(range(1, len(m) + 1)) AS u(i)),
kept AS (SELECT * FROM spans d WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = d.doc_id AND o.priority <= d.priority
  AND o.b <= d.b AND o.b + o.size >= d.b + d.size AND (o.b, -(o.b + o.size), o.priority, o.rule) < (d.b, -(d.b + d.size), d.priority, d.rule))),
found AS (SELECT doc_id, max(weight) AS score FROM kept GROUP BY 1),
names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM places) GROUP BY 1),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
  coalesce(base_names.l, '') AS base_labels, coalesce(names.l, '') AS labels, coalesce(found.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN base_names USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN found USING (doc_id)"""


NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS g, count(*) AS n
  FROM w, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0 GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM common JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 5 * c >= 4 * (a.size + b.size - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c"""

REPEATS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM w, unnest(range(1, len(ws) - 48)) AS u(i)),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS places FROM win JOIN first USING (k), unnest(range(50)) AS u(j) WHERE low < doc_id GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""

TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

RANKING = f"""
WITH lower_case AS (SELECT doc_id, translate(text, '{licenses.UPPER}', '{licenses.LOWER}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {TERMS}) AS ws FROM lower_case),
d AS (SELECT doc_id, len(ws)::BIGINT AS n FROM w WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), {TERMS})) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM tf, totals GROUP BY term, n_docs),
scores AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // total))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""

ORACLES = {
    "op13_mask_ranking": RANKING,
    "op2_url_aliases": _urls(),
    "op3_license_rules": _licenses(),
    "op5_bag_minhash": NEAR,
    "op6_weighted_mix": mixing.ORACLE,
    "op10_fm_index_repeats": REPEATS,
}
