"""SQL of the operators' queries for DuckDB, where SQL can say them: by brute force, not by the operators' methods."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

#: Words: runs without space and the controls 9 to 13.
WORD = r"'[^\x20\x09-\x0D]+'"

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024e0 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs QUALIFY rank <= 10"""

# A window starts with a shingle of the item and has as many shingles, or those up to the document's end.
OP4 = r"""WITH w AS (SELECT doc_id AS id, 0 AS kind, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
UNION ALL SELECT item_id, 1, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
spot AS (SELECT id, kind, w, unnest(range(len(w) - 4)) AS p FROM w WHERE len(w) >= 5), s AS (SELECT id, kind, p, len(w) - 4 AS n, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM spot),
item AS (SELECT id AS item_id, n, s, count(*) AS times FROM s WHERE kind = 1 GROUP BY ALL), hit AS (SELECT d.id AS doc_id, d.p, d.n AS long, i.item_id, i.n, i.times, s FROM s d JOIN item i USING (s) WHERE d.kind = 0),
shared AS (SELECT a.doc_id, a.item_id, a.p AS start, a.n, least(a.n, a.long - a.p) AS m, b.s, least(count(*), any_value(b.times)) AS k FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.n GROUP BY ALL),
judged AS (SELECT doc_id, item_id, start, sum(k) / (m + n - sum(k)) AS similarity FROM shared GROUP BY doc_id, item_id, start, m, n)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_min(start, (-similarity, start)) AS INT) AS start FROM judged WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id"""

OP8 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), {WORD}) AS w FROM documents),
spot AS (SELECT row, doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS p FROM w WHERE len(w) > 0), s AS (SELECT DISTINCT row, doc_id, array_to_string(w[p + 1 : p + 4], ' ') AS s FROM spot),
n AS (SELECT row, doc_id, count(*) AS n FROM s GROUP BY ALL), pairs AS (SELECT a.row AS a, b.row AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.row < b.row GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100*k >= 80*(x.n + y.n - k)), both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT row AS a, row AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b), least_ AS (SELECT a AS row, min(doc_id) AS component FROM reach JOIN n ON n.row = b GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept FROM w LEFT JOIN n USING (row) LEFT JOIN least_ USING (row)"""

OP10 = f"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents), spot AS (SELECT row, doc_id, w, unnest(range(len(w) - 19)) AS p FROM w WHERE len(w) >= 20),
s AS (SELECT row, doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS s FROM spot), late AS (SELECT row, p FROM (SELECT row, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY s) AS late FROM s) WHERE late),
gone AS (SELECT DISTINCT row, p + i AS p FROM late CROSS JOIN range(20) AS r(i)), words AS (SELECT row, unnest(range(len(w))) AS p, unnest(w) AS word FROM w),
left_ AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (row, p) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (row)"""

ORACLE = {"op3_topk": OP3, "op4_decontamination": OP4, "op8_near_duplicates": OP8, "op10_substring_dedup": OP10}
