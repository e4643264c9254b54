"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key, row_number() OVER () AS i FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1)::BIGINT AS rank FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight FROM p),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, row_number() OVER (ORDER BY source_size / weight, rank) AS n FROM w),
g AS (SELECT a.n, max(a.source_size * 2.0) AS full, max(a.weight * (1.5 * a.total - 2.0 * coalesce(b.used, 0)) / (c.left_weight)) AS fair, max(a.weight) AS weight
  FROM f a LEFT JOIN LATERAL (SELECT sum(source_size) AS used FROM f x WHERE x.n < a.n) b ON true LEFT JOIN LATERAL (SELECT sum(weight) AS left_weight FROM f x WHERE x.n >= a.n) c ON true GROUP BY a.n),
h AS (SELECT n, fair / weight AS level FROM g WHERE "full" > fair ORDER BY n LIMIT 1),
t AS (SELECT f.source, f.rank, f.source_size, (CASE WHEN f.n >= (SELECT n FROM h) THEN f.weight * (SELECT level FROM h) ELSE f.source_size * 2.0 END)::DOUBLE AS target FROM f),
k AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM s),
r AS (SELECT k.i, k.doc_id, k.size, t.source_size, t.target, t.rank, k.middle + e * t.source_size AS middle, e FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source, range(0, 2) x(e)),
v AS (SELECT *, CASE rank % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a, CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS c, least(greatest(CASE WHEN target > 0 THEN middle / target ELSE 0 END, 0.0), 1.0)::DOUBLE AS u FROM r),
z AS (SELECT *, CASE WHEN middle < target THEN round(CASE WHEN u <= (a + 1) / 4
    THEN least(2 * u / (a + sqrt(greatest(a * a + 4 * (1 - a) * u, 0))), 0.5)
    ELSE 0.5 + 2 * (u - (a + 1) / 4) / (1 + sqrt(greatest(1 + 4 * (c - 1) * (u - (a + 1) / 4), 0))) END, 9) END AS position FROM v)
SELECT doc_id, size, source_size, target, (size * count(position))::BIGINT AS taken, max(position) FILTER (e = 0) AS position, max(position) FILTER (e = 1) AS second_position
FROM z GROUP BY i, doc_id, size, source_size, target
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(a), 0) = 0 THEN []::VARCHAR[] WHEN len(a) < 3 THEN [array_to_string(a, ' ')] ELSE [array_to_string(a[i:i + 2], ' ') FOR i IN range(1, len(a) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""

OP10 = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

# CRC-32 a byte at a time, with the table made by its rule (reflected polynomial 0xEDB88320).
OP9 = """
WITH tab AS (SELECT list(list_reduce(range(0, 8)::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, [('0x' || h[i:i + 1])::BIGINT FOR i IN range(1, length(h), 2)] AS bytes FROM d),
c AS (SELECT doc_id, len(bytes) + 8 AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b, tab),
r AS (SELECT doc_id, s, -ln((('0x' || md5(doc_id::VARCHAR || ':' || s)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS cost FROM documents, range(0, 25) x(s)),
w AS (SELECT doc_id, arg_min(s, cost) FILTER (s < 24) AS shard, arg_min(s, cost) AS grown_shard FROM r GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR || ':' || text_crc32::VARCHAR)[1:3], doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM c JOIN w USING (doc_id)
"""

# CRC-32 of each different word, as in OP9.
OP12 = r"""
WITH tab AS (SELECT list(list_reduce(range(0, 8)::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
x AS (SELECT i, w, count(*) AS n FROM (SELECT i, unnest(a) AS w FROM d) GROUP BY ALL), y AS (SELECT w, count(*) AS n FROM (SELECT unnest(a) AS w FROM b) GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM y)),
c AS (SELECT w, xor(list_reduce([('0x' || h[i:i + 1])::BIGINT FOR i IN range(1, length(h), 2)], lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(n) AS s FROM x JOIN c USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM y JOIN c USING (w) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
v AS (SELECT i, sum(n * gain)::BIGINT AS weight FROM x JOIN c USING (w) JOIN g USING (bucket) GROUP BY i),
r AS (SELECT i, doc_id, len(a)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN v USING (i)),
k AS (SELECT *, weight + noise AS score, row_number() OVER (ORDER BY n_features < 20, weight + noise DESC, doc_id NULLS LAST) AS rank FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r WHERE n_features >= 20) THEN rank END::BIGINT AS rank FROM k
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
q AS (SELECT own, item_id, w, count(*) AS k FROM (SELECT row_number() OVER () AS own, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
z AS (SELECT count(*) FILTER (len(a) > 0)::BIGINT AS N, sum(len(a))::BIGINT AS L FROM d),
p AS (SELECT i, w, count(*) AS tf FROM (SELECT i, unnest(a) AS w FROM d) SEMI JOIN q USING (w) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, z GROUP BY w, N),
x AS (SELECT p.i, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(a)::BIGINT * N) // L))) AS part FROM p JOIN d USING (i) JOIN f USING (w), z),
s AS (SELECT own, item_id, i, sum(k * part)::BIGINT AS score FROM q JOIN x USING (w) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY own ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (i) WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {"op9_sharding": OP9, "op10_topk": OP10, "op6_jaccard_join": OP6, "op2_mixing": OP2, "op12_resampling": OP12, "op13_ranked": OP13}
