"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, spans.n FROM spans JOIN wins ON spans.s = wins.s AND spans.n = wins.n),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = r"""
WITH g AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || coalesce('=' || source, '-')) AS g
  FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY g) - 1 AS nth FROM g),
v AS (SELECT doc_id, source, size, CASE WHEN nth = 0 THEN g ELSE md5(g || ':' || CAST(nth AS VARCHAR)) END AS draw FROM m),
d AS (SELECT *, (CAST('0x' || substr(draw, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM v),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w::DOUBLE, source NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE 3 * n / w::DOUBLE > level),
t AS (SELECT l.source, l.n, CASE WHEN l.k < coalesce(f.k, 1000000000) THEN (3 * l.n)::DOUBLE ELSE l.w * f.level END AS target FROM l, f),
e AS (SELECT d.*, t.n AS source_size, t.target, CASE WHEN t.n = 0 THEN 0.0::DOUBLE ELSE least(t.target / t.n::DOUBLE, 3.0::DOUBLE) END AS raw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN abs(raw - round(raw)) < 1e-9 THEN round(raw) ELSE raw END AS mean FROM e),
q AS (SELECT *, CASE WHEN mean > floor(mean) THEN u / (1 - u) * ((1 - (mean - floor(mean))) / (mean - floor(mean))) END AS rank FROM r),
c AS (SELECT *, target - sum(size * floor(mean)) OVER (PARTITION BY source) AS remaining,
    sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, size, draw ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, source, size, source_size, target,
  CAST(floor(mean) + CASE WHEN rank IS NOT NULL AND upto - size < remaining AND 2 * upto - size < 2 * remaining THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST(size * copies AS BIGINT) AS taken
FROM c
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b,
    CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c,
    CASE WHEN i > 1 THEN w[i - 1] END AS ca, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS cb
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT doc_id, a AS g FROM p UNION ALL SELECT doc_id, b FROM p WHERE b IS NOT NULL UNION ALL SELECT doc_id, c FROM p WHERE c IS NOT NULL),
o AS (SELECT doc_id, g, count(*) AS own FROM g GROUP BY ALL),
x AS (SELECT doc_id, g, sum(own) OVER (PARTITION BY g) - own AS k FROM o),
s AS (SELECT p.doc_id, p.n, a.k AS ka, b.k AS kb, c.k AS kc, ca.k AS kca, cb.k AS kcb, (SELECT count(*) FROM p) - p.n AS rest
  FROM p JOIN x a ON a.doc_id = p.doc_id AND a.g = p.a
  LEFT JOIN x b ON b.doc_id = p.doc_id AND b.g = p.b LEFT JOIN x c ON c.doc_id = p.doc_id AND c.g = p.c
  LEFT JOIN x ca ON ca.doc_id = p.doc_id AND ca.g = p.ca LEFT JOIN x cb ON cb.doc_id = p.doc_id AND cb.g = p.cb),
u AS (SELECT doc_id, n, ln(CASE WHEN kc > 0 THEN kc::DOUBLE / kcb::DOUBLE
    ELSE (CASE WHEN kc IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN kb > 0 THEN kb::DOUBLE / kca::DOUBLE
    ELSE (CASE WHEN kb IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN ka > 0 THEN ka::DOUBLE / rest::DOUBLE ELSE 1.0::DOUBLE / (rest + 1)::DOUBLE END) END) END) AS l FROM s),
t AS (SELECT doc_id, sum(l) AS l FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0.0::DOUBLE), 4) AS log_score, round(l / len(w)::DOUBLE, 6) AS mean_log_score
FROM d LEFT JOIN t USING (doc_id)
"""

OP3 = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT source, trim(x) AS line FROM (SELECT source, unnest(ls) AS x FROM d) WHERE trim(x) <> '' AND source IS NOT NULL),
b AS (SELECT list(line) AS bad FROM (SELECT line FROM l GROUP BY line HAVING count(DISTINCT source) >= 5)),
k AS (SELECT doc_id, text, ls, [x FOR x IN ls IF NOT coalesce(list_contains(bad, trim(x)), false)] AS kept FROM d, b)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM k
"""

OP2 = r"""
WITH p AS (SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, host, path, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
s AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(action, len(rule)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, s.rule, CASE WHEN s.action IS NOT NULL THEN s.action
  WHEN regexp_matches(low, '(?s)(?:\A|://)(?:[^/?#]*\.)?blog\..*/en/') THEN 'allow'
  WHEN regexp_matches(low, '(?s)(?:\A|://)(?:[^/?#]*\.)?(?:casino-win|free-bets|cheap-pills)\.') THEN 'block'
  WHEN contains(low, '/ads/') THEN 'block'
  WHEN regexp_matches(low, '(?s)[^a-z0-9\-.%_]utm_source=spam(?:[^a-z0-9\-.%_]|\z)') THEN 'block'
  WHEN regexp_matches(low, '(?s)/en/.*\.php(?:[^a-z0-9\-.%_]|\z)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM p LEFT JOIN s USING (page_id)
"""

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP11 = rf"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
o AS (SELECT doc_id, {_SPACED} AS w, xor(list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
e AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS edited, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS share FROM o),
f AS (SELECT doc_id, n, CASE WHEN edited THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // share) END] FOR i IN range(n)] ELSE w END AS w FROM e),
p AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM f),
same AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM p l JOIN p r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND r.i - l.i <= l.n // 4),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
spans AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans t
  WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
texts AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS s FROM runs GROUP BY doc_id),
cut AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM p ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
  sha256(coalesce(texts.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM f LEFT JOIN texts USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS t FROM documents),
n AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS total FROM d),
p AS (SELECT r, doc_id, n, x, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS x FROM d) GROUP BY r, doc_id, n, x),
f AS (SELECT x, count(*) AS df FROM p GROUP BY x),
w AS (SELECT x, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, n),
q AS (SELECT i, item_id, unnest(list_distinct(t)) AS x FROM (SELECT row_number() OVER () AS i, item_id, {_ALNUM} AS t FROM benchmark)),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * p.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (x) JOIN w USING (x), n GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""

ORACLES = {
    "op12_odd_sketches": OP12,
    "op13_ranked_search": OP13,
    "op11_periodic_runs": OP11,
    "op2_url_filters": OP2,
    "op3_line_spread": OP3,
    "op7_stupid_backoff": OP7,
    "op8_benchmark_decontamination": OP8,
    "op9_pareto_mixing": OP9,
}
