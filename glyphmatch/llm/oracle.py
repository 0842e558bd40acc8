"""What SQL can express of the training-data operators, each over its whole table."""

OP1_WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, octet_length(payload)::BIGINT AS payload_bytes, upper(sha1(payload)) AS h, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

OP2_LINE_DEDUP = r"""
WITH RECURSIVE split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, k::INT AS place, parts[k] AS line FROM split, unnest(range(1, len(parts) + 1)) u(k) WHERE ltrim(parts[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
named AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM lines)),
sets AS (SELECT id, list_distinct(CASE WHEN length(line) < 8 THEN [line] ELSE list_transform(range(1, length(line) - 6), lambda y: substr(line, y::INT, 8)) END) AS g FROM named),
sizes AS (SELECT id, len(g)::BIGINT AS n FROM sets),
e AS (SELECT id, unnest(g) AS g FROM sets),
often AS (SELECT g, count(*) AS f FROM e GROUP BY g),
ranked AS (SELECT e.id, e.g, sizes.n, row_number() OVER (PARTITION BY e.id ORDER BY f, e.g) AS r FROM e JOIN often USING (g) JOIN sizes USING (id)),
-- of two sets that are alike enough, one of the rarest fifth of either's shingles is in both
probe AS (SELECT id, g, n FROM ranked WHERE r <= n // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM probe a JOIN probe b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.id = x JOIN sets q ON q.id = y WHERE 100 * len(list_intersect(p.g, q.g)) >= 80 * (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g)))),
ends AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, c) AS (SELECT id, id FROM named UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.a WHERE reach.c < ends.b),
groups AS (SELECT a AS id, min(c) AS c FROM reach GROUP BY a),
placed AS (SELECT doc_id, place, row_number() OVER (PARTITION BY c ORDER BY doc_id, place) AS r FROM lines JOIN named USING (line) JOIN groups USING (id)),
gone AS (SELECT doc_id, list(place) AS places FROM placed WHERE r > 1 GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT s.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(len(g.places), 0)::BIGINT AS n_removed,
  CASE WHEN g.places IS NULL THEN s.text ELSE array_to_string(list_transform(list_filter(range(1, len(s.parts) + 1), lambda k: NOT list_contains(g.places, k::INT)), lambda k: s.parts[k]), chr(10)) END AS text
FROM split s LEFT JOIN gone g USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""

OP5_MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 3 THEN [array_to_string(v, ' ')] ELSE list_transform(range(1, len(v) - 1), lambda k: v[k] || ' ' || v[k + 1] || ' ' || v[k + 2]) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * met.n >= 85 * (p.n + q.n - met.n)),
ends AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT ends.b, r.c FROM r JOIN ends ON ends.a = r.a WHERE r.c < ends.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP6_SUFFIX_ARRAY_DEDUP = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, length(h) // 2 AS n, h FROM t),
w AS (SELECT doc_id, k::BIGINT AS k, md5(substr(h, 2 * k::INT + 1, 400)) AS m FROM s, unnest(range(0, n - 199)) u(k)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM w SEMI JOIN again USING (m)),
run AS (SELECT doc_id, k, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hit),
span AS (SELECT doc_id, r, min(k) AS i, max(k) + 200 AS j FROM run GROUP BY ALL),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(j - i) AS n_removed, list(i ORDER BY i) AS b, list(j ORDER BY i) AS e FROM span GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.b IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(c.b) + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE c.e[k] END)::INT + 1, 2 * ((CASE WHEN k = len(c.b) THEN s.n ELSE c.b[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE c.e[k] END))::INT)), '') END)) AS kept_sha256
FROM s LEFT JOIN cuts c ON c.doc_id = s.doc_id
"""

URL_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
met AS (SELECT page_id, r.h || r.p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN met ON met.page_id = h.page_id AND k = 1
"""

QUALITY_COUNTS = r"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS v, string_split(text, chr(10)) AS parts FROM s),
windows AS (SELECT doc_id, k, v[k] || ' ' || v[k + 1] || ' ' || v[k + 2] AS g FROM w, unnest(range(1, len(v) - 1)) u(k)),
often AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT k + d) AS n FROM (windows SEMI JOIN often USING (doc_id, g)), (VALUES (0), (1), (2)) o(d) GROUP BY doc_id),
lines AS (SELECT doc_id, parts[k] AS line FROM w, unnest(range(1, len(parts) + 1)) u(k) WHERE regexp_matches(parts[k], '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
counted AS (
SELECT w.doc_id, len(v)::BIGINT AS n_words, coalesce(list_sum(list_transform(v, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN dups ON dups.doc_id = w.doc_id LEFT JOIN repeats ON repeats.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""
