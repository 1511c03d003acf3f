"""SQL that the operators' queries are held against, where SQL can express them."""
from __future__ import annotations

HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
KEY = HOST + " || " + PATH + r" || coalesce(regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)?', 1, 's'), '')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, html FROM p),
b AS (SELECT page_id, payload_bytes, html, max(page_id) OVER (PARTITION BY html) AS first,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

OP8 = f"""
WITH RECURSIVE rules(verdict, text, host, path) AS (VALUES ('allow', 'org/', 'org', '/'),
  ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
u AS (SELECT page_id, url, html, {HOST} AS host, {PATH} AS path, {KEY} AS key FROM pages),
tags AS (SELECT url, host, key, unnest(regexp_extract_all(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is')
  || regexp_extract_all(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is')) AS tag
  FROM u WHERE url IS NOT NULL AND html IS NOT NULL),
named AS (SELECT host, key, replace(coalesce(
  nullif(regexp_extract(tag, '\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'), ''),
  nullif(regexp_extract(tag, '\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'is'), '')), '&amp;', '&') AS href FROM tags),
targets AS (SELECT key AS a, CASE WHEN contains(href, '://') THEN href WHEN href LIKE '//%' THEN 'http:' || href
  WHEN href LIKE '/%' THEN 'http://' || host || href END AS url FROM named),
links AS (SELECT DISTINCT a, {KEY} AS b FROM targets WHERE url IS NOT NULL),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ends AS (SELECT DISTINCT b, host, path FROM (SELECT b, 'x://' || b AS url FROM reach), LATERAL (SELECT {HOST} AS host, {PATH} AS path)),
fits AS (SELECT b, arg_max(r.verdict, length(text)) AS verdict FROM ends e JOIN rules r
  ON (e.host = r.host OR e.host LIKE '%.' || r.host) AND starts_with(e.path, r.path) GROUP BY b),
spread AS (SELECT a, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM reach JOIN fits USING (b) GROUP BY a),
ruled AS (SELECT page_id, arg_max(text, length(text)) AS rule, arg_max(verdict, length(text)) AS verdict FROM
  (SELECT DISTINCT page_id, u.host, u.path, text, verdict FROM u JOIN rules r
  ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN ruled USING (page_id) LEFT JOIN spread ON spread.a = u.key
"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score
  FROM g q JOIN g c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = t.doc_id
"""

OP12 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM win JOIN low USING (g) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

RUNS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP13 = f"""
WITH d AS (SELECT doc_id, {RUNS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest({RUNS}) AS x FROM benchmark),
steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
kinds AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
hashed AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) % 10000 AS bucket FROM kinds, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (x) GROUP BY bucket),
gain AS (SELECT b.range AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE)
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op3_neighbours": OP3, "op4_ngram_join": OP4, "op8_url_filters": OP8,
                           "op12_factors": OP12, "op13_resampling": OP13}
