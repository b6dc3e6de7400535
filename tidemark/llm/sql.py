"""DuckDB SQL that gives the same rows as the text queries, where SQL can say it."""

JACCARD_COMPONENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = n.doc_id
"""

REMOVED_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS p, h FROM d WHERE length(h) >= 200),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM w),
e AS (SELECT doc_id, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY s) AS again FROM g),
r AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e WHERE again),
i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, k),
j AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS n FROM j),
s AS (SELECT doc_id, n, min(a) AS a, max(b) AS b FROM q GROUP BY doc_id, n),
k AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

WARC_RECORDS = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM q WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN f END AS refers_to
FROM r
"""

LINES_KEPT = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, CAST(len(ls) + 1 AS BIGINT))) AS p, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.p, k.line, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, CAST(len(ws) + 2 - k AS BIGINT)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g, k
      FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, g, k, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
parts AS (SELECT lang, g, k, f, string_split(g, ' ') AS ws FROM f),
held AS (SELECT lang, array_to_string(ws[1:2], ' ') AS g, f FROM parts WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM parts WHERE k = 3),
most AS (SELECT lang, g, max(f) AS most FROM held GROUP BY ALL),
c AS (SELECT p.lang, p.g, p.k, p.f, p.ws, unnest(range(1, p.k)) AS j FROM parts p LEFT JOIN most m ON m.lang = p.lang AND m.g = p.g
      WHERE p.k = 3 OR (p.k = 2 AND 100 * coalesce(m.most, 0) < 50 * p.f)),
s AS (SELECT c.lang, c.g, c.f AS a, c.j, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.ws[1:c.j], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.ws[c.j + 1:c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS b FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best WHERE b = 1)
SELECT r.lang, rank, g AS phrase, a, l, r.r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""

RESAMPLED = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
g AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, CAST(len(ws) AS BIGINT)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
u AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM g),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1 AS BIGINT) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
        lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 10000 AS b FROM u, tab),
c AS (SELECT side, id, b FROM g JOIN b ON b.g = g.g),
totals AS (SELECT CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS t FROM c),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) + 1) * (any_value(s) + 10000) / ((CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) + 1) * (any_value(t) + 10000)))) AS BIGINT) AS gain FROM c, totals GROUP BY b),
m AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM c JOIN gain ON gain.b = c.b WHERE side = 0 GROUP BY id),
d AS (SELECT w.id AS doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
        substr(sha256('7:' || CAST(w.id AS VARCHAR)), 1, 8) AS x FROM w LEFT JOIN m ON m.id = w.id WHERE side = 0),
h AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(x, i, 1)) - 1 AS BIGINT))), lambda v, y: v * 16 + y) AS h FROM d),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS many FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN place END AS rank FROM r
"""
