"""DuckDB SQL that gives the rows of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op9_warc_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

SQL["op10_benchmark_hits"] = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase FROM bw, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT * FROM dw, sizes), unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) t(i)),
hit AS (SELECT o.doc_id, o.i, o.k, win.item_id FROM occ o JOIN win ON o.phrase = win.phrase AND o.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, generate_series(0, 12) t(j) WHERE j < k GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op8_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u),
comp AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.u = v.vec_id) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept FROM v JOIN comp ON comp.u = v.vec_id
"""

SQL["op2_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT CAST(pow(2, greatest(0, ceil(log2(count(*) / 4096.0)))) AS BIGINT) AS shards FROM d),
p AS (SELECT d.*, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard FROM d, k),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM p GROUP BY source),
s1 AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights, count(*) OVER () AS n FROM s0),
s2 AS (SELECT *, total - CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS left_t, weights - CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS left_w FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * left_w < left_t * weight AS is_full FROM s2),
lv AS (SELECT left_t AS lt, left_w AS lw FROM s3 WHERE NOT is_full ORDER BY cap / weight LIMIT 1),
s4 AS (SELECT source, source_size, total, n, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE least(weight * CAST(lt AS DOUBLE) / lw, CAST(cap AS DOUBLE)) END AS target FROM s3, lv),
s5 AS (SELECT *, greatest(1, least(16, total // (1000 * n))) AS block FROM s4),
s6 AS (SELECT *, (total + block // 2) // block AS blocks FROM s5),
q AS (SELECT source, i, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, source NULLS LAST, i) AS r, blocks FROM s6, unnest(range(0, CAST(target / block + n + 3 AS BIGINT))) t(i) WHERE target > 0),
sb AS (SELECT s6.*, coalesce(b, 0) AS source_blocks FROM s6 LEFT JOIN (SELECT source, count(*) AS b FROM q WHERE r <= blocks GROUP BY source) x ON x.source IS NOT DISTINCT FROM s6.source),
cell AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM p GROUP BY source, shard),
c1 AS (SELECT sb.source, shard, cell_size, source_size, source_blocks, block, target, count(*) OVER (PARTITION BY sb.source) AS nc FROM cell JOIN sb ON cell.source IS NOT DISTINCT FROM sb.source),
cq AS (SELECT source, shard, source_blocks, row_number() OVER (PARTITION BY source ORDER BY cell_size / (2 * i + 1) DESC, shard, i) AS r FROM c1, unnest(range(0, CAST(cell_size * source_blocks / source_size + nc + 3 AS BIGINT))) t(i) WHERE cell_size > 0),
c2 AS (SELECT c1.*, coalesce(b, 0) AS cell_blocks FROM c1 LEFT JOIN (SELECT source, shard, count(*) AS b FROM cq WHERE r <= source_blocks GROUP BY source, shard) x ON x.source IS NOT DISTINCT FROM c1.source AND x.shard = c1.shard),
c3 AS (SELECT *, least(cell_blocks * block, cell_size * 3) AS words FROM c2),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM p)
SELECT o.doc_id, o.size, c3.source_size, c3.target, CASE WHEN cell_size = 0 THEN 0 ELSE CAST((words // cell_size) * size + greatest(0, least(size, words % cell_size - prior)) AS BIGINT) END AS taken
FROM o JOIN c3 ON o.source IS NOT DISTINCT FROM c3.source AND o.shard = c3.shard
"""

SQL["op5_substring_fm_index"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase FROM d, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, generate_series(0, 12) t(j)),
kept AS (SELECT d.doc_id, string_agg(w[p], ' ' ORDER BY p) AS text FROM d, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) t(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.pos = p) GROUP BY d.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM d, unnest(range(1, CAST(greatest(len(w) - 4, 1) + 1 AS BIGINT))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_of JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = d.doc_id
"""

SQL["op7_run_length_index"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
piece AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2 * (1024 + 99)) AS s FROM d, unnest(range(0, n - 99, 1024)) t(p)),
win AS (SELECT doc_id, p + i AS start, md5(substr(s, 2 * i + 1, 200)) AS w FROM piece, unnest(range(0, least(1024, len(s) // 2 - 99))) t(i)),
later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS r FROM win) WHERE r > 1),
step AS (SELECT doc_id, start, CASE WHEN start > lag(start) OVER o + 100 THEN 1 ELSE 0 END AS opens FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
numbered AS (SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM step),
span AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS e FROM numbered GROUP BY doc_id, g),
gone AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e FROM span UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(x, 2 * gap.a + 1, 2 * (gap.e - gap.a)), '' ORDER BY gap.a))) AS kept_sha256 FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
