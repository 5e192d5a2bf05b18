"""The same queries in plain SQL, where SQL can say it."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest FROM p),
     g AS (SELECT digest, max(page_id) AS largest FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n >= 1000 AND largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND largest <> page_id THEN largest END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size,
                  [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
           FROM d GROUP BY source),
     c AS (SELECT *, source_size * 3 AS cap,
                  coalesce(sum(source_size * 3) OVER o, 0)::BIGINT AS cap_before,
                  coalesce(sum(w) OVER o, 0)::BIGINT AS w_before,
                  (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w
           FROM s WINDOW o AS (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f AS (SELECT max((total - cap_before) / (all_w - w_before)) AS fill FROM c),
     t AS (SELECT source, source_size, least(cap::DOUBLE, w * fill) AS target FROM c, f),
     r AS (SELECT d.doc_id, size, source_size, target,
                  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP7 = r"""
WITH u AS (SELECT page_id,
                  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
           FROM pages),
     m AS (SELECT page_id, host, path, CASE
             WHEN host = 'www.example.com' OR ends_with(host, '.www.example.com') THEN
               CASE WHEN starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
             WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN
               CASE WHEN starts_with(path, '/en/') THEN 'example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
             WHEN host = 'net' OR ends_with(host, '.net') THEN
               CASE WHEN starts_with(path, '/es/') THEN 'net/es/' WHEN starts_with(path, '/fr/') THEN 'net/fr/' END
           END AS rule FROM u),
     v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM m),
     parts AS (SELECT host, count(*) FILTER (said = 'allow') AS good, count(rule) AS n,
                      CASE WHEN len(string_split(host, '.')) > 1 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS pair
               FROM v GROUP BY host),
     h AS (SELECT host, good, n,
                  CASE WHEN pair IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.kr', 'com.cn', 'com.mx', 'co.za')
                       THEN pair ELSE string_split(host, '.')[-1] END AS suffix,
                  CASE WHEN pair IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.kr', 'com.cn', 'com.mx', 'co.za')
                       THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE pair END AS domain
           FROM parts),
     dm AS (SELECT suffix, domain, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
     sx AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM dm GROUP BY ALL),
     g AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS mean, sum(n) + 2.0::DOUBLE AS held FROM sx),
     s1 AS (SELECT sx.*, mean, held FROM sx, g),
     k1 AS (SELECT CASE WHEN rho >= 1 THEN 0.0::DOUBLE WHEN rho > 0 THEN 1 / rho - 1 END AS k FROM (SELECT CASE WHEN sum((n - 1) * mean * (1 - mean)) > 0
              THEN round(sum(n * (good / n - mean) ** 2 - mean * (1 - mean)) / sum((n - 1) * mean * (1 - mean)), 9) END AS rho FROM s1 WHERE n > 0)),
     p1 AS (SELECT suffix, CASE WHEN n + k > 0 THEN (good + k * mean) / (n + k) ELSE mean END AS mean, coalesce(n + k, held) AS held FROM s1, k1),
     s2 AS (SELECT dm.*, mean, held FROM dm JOIN p1 USING (suffix)),
     k2 AS (SELECT CASE WHEN rho >= 1 THEN 0.0::DOUBLE WHEN rho > 0 THEN 1 / rho - 1 END AS k FROM (SELECT CASE WHEN sum((n - 1) * mean * (1 - mean)) > 0
              THEN round(sum(n * (good / n - mean) ** 2 - mean * (1 - mean)) / sum((n - 1) * mean * (1 - mean)), 9) END AS rho FROM s2 WHERE n > 0)),
     p2 AS (SELECT suffix, domain, CASE WHEN n + k > 0 THEN (good + k * mean) / (n + k) ELSE mean END AS mean, coalesce(n + k, held) AS held FROM s2, k2),
     s3 AS (SELECT h.*, mean, held FROM h JOIN p2 USING (suffix, domain)),
     k3 AS (SELECT CASE WHEN rho >= 1 THEN 0.0::DOUBLE WHEN rho > 0 THEN 1 / rho - 1 END AS k FROM (SELECT CASE WHEN sum((n - 1) * mean * (1 - mean)) > 0
              THEN round(sum(n * (good / n - mean) ** 2 - mean * (1 - mean)) / sum((n - 1) * mean * (1 - mean)), 9) END AS rho FROM s3 WHERE n > 0)),
     p3 AS (SELECT host, coalesce(n + k, held) AS weight, CASE WHEN n + k > 0 THEN (good + k * mean) / (n + k) ELSE mean END AS mean FROM s3, k3),
     b AS (SELECT host, round(least(1.0, mean + 1.64 * sqrt(mean * (1 - mean) / (weight + 1))), 9) AS bound FROM p3)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM v JOIN b ON v.host = b.host
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
"""

ORACLES = {"op1_warc": OP1, "op6_mixing": OP6, "op7_urls": OP7, "op10_topk": OP10}

OP3 = rf"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
     r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
ORACLES["op3_jaccard"] = OP3

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, part, text, regexp_extract_all(text, '{WORD}') AS ws,
                  min(doc_id) OVER (PARTITION BY text) AS first FROM d),
     l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, concat(CASE WHEN len(ws) < 100 THEN 'A' END,
                               CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
                               CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' END,
                               CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                               CASE WHEN w.doc_id > first THEN 'E' END) AS fails, good, toxic
           FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
     c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, own,
                  sum(n) FILTER (translate(fails, before || own, '') = fails) AS kept,
                  sum(n) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS removed,
                  sum(n) FILTER (translate(fails, before, '') <> fails AND contains(fails, own)) AS redundant,
                  sum(n) FILTER (fails = own) AS unique_fails,
                  sum(good) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS good_lost,
                  sum(toxic) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS toxic_lost
           FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""
ORACLES["op12_audit"] = OP12
