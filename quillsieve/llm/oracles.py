"""SQL (DuckDB) for the corpus queries that SQL can express on small tables."""

from quillsieve.llm.xxh64_sql import xxh64

SUBSTRING_DEDUP = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS r FROM s) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM again),
one AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r GROUP BY vec_id
"""
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, p, md5(b[p + 1:p + 400]) AS k FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS p FROM t)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
marked AS (SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, -1))::INT AS new FROM again),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked) GROUP BY doc_id, r),
parts AS (SELECT doc_id, e AS begin, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000000) AS stop, e - a AS n FROM runs UNION ALL SELECT doc_id, 0, min(a), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[begin + 1:stop]), '' ORDER BY begin) AS h, sum(n) AS n_removed, count(n) AS n_spans FROM parts JOIN t USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 50], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 49)) AS p FROM w)),
passages AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, p, unnest(range(51)) AS o FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM v) WHERE c > 1) GROUP BY doc_id)
SELECT t.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256, coalesce(passages.n, 0) AS n_passage_words
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SIMHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[p:p + 3], ' ') AS item FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item) AS id, item FROM (SELECT DISTINCT item FROM s)),
h AS MATERIALIZED (SELECT doc_id, h FROM s JOIN d USING (item) JOIN {xxh64('SELECT * FROM d')} x ON x.id = d.id),
bits AS (SELECT doc_id, b, sum(((h >> b) & 1)::BIGINT) AS ones, count(*) AS n FROM (SELECT doc_id, h, unnest(range(64))::UBIGINT AS b FROM h) GROUP BY doc_id, b),
f AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN 2 * ones > n THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS fp FROM bits GROUP BY doc_id) USING (doc_id)),
p AS MATERIALIZED (SELECT fp, min(doc_id) AS node FROM f GROUP BY fp),
l AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM p a JOIN p b ON a.node <> b.node AND bit_count(xor(a.fp, b.fp)::BIT) <= 4),
r AS (SELECT node, node AS c FROM p UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.node)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN p USING (fp) JOIN (SELECT node, min(c) AS component_id FROM r GROUP BY node) USING (node)
"""
