"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

_COMPONENTS = "e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT id, id AS c FROM ids UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a), comp AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"

OP1 = rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
i AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM i x JOIN i y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), {_COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, comp.component_id, comp.component_id = s.doc_id AS kept FROM s JOIN comp ON comp.id = s.doc_id"""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i+19], ' ') END)) AS g FROM w),
f AS (SELECT g, min(doc_id * 100000000 + p) AS first FROM p WHERE g IS NOT NULL GROUP BY g),
d AS (SELECT p.doc_id, p.p, p.word, (f.first IS NOT NULL AND f.first <> p.doc_id * 100000000 + p.p)::INT AS copy FROM p LEFT JOIN f ON f.g = p.g),
c AS (SELECT doc_id, p, word, sum(copy) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone FROM d),
k AS (SELECT doc_id, CAST(sum(gone::INT) AS BIGINT) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ids AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT comp.id AS vec_id, coalesce(n.n, 0) AS n_links, comp.component_id, comp.component_id = comp.id AS kept FROM comp LEFT JOIN n ON n.a = comp.id"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, '')) || ':' || coalesce('s' || source, 'n')) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
o AS (SELECT *, [3.0, 1.0, 2.0][i % 3 + 1] AS w, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / [3.0, 1.0, 2.0][i % 3 + 1], i) AS k, 0.8 * (2.0 * i / greatest(count(*) OVER () - 1, 1) - 1) AS tilt FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, 1.5 * sum(source_size) OVER () AS budget FROM o),
level AS (SELECT (budget - capped) / open_w AS level FROM c WHERE (budget - capped) / open_w * w <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CAST(tilt AS DOUBLE) AS tilt, round(CAST(least(cap, (SELECT level FROM level) * w) AS DOUBLE), 6) AS target FROM c),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt, CAST(round(t.target) AS BIGINT) AS quota, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, greatest(least(quota - place, size), 0) + greatest(least(quota - source_size - place, size), 0) AS taken,
 CASE WHEN size > 0 AND place < quota THEN round(2.0 * (place * 1.0::DOUBLE / quota) / (1 + tilt + sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * (place * 1.0::DOUBLE / quota))), 6) END AS position FROM a"""

ORACLES = {"op1_minhash": OP1, "op2_rlz": OP2, "op3_projection": OP3, "op5_curriculum": OP5}
