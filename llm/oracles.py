"""DuckDB statements for those queries that SQL can express.  They serve as a check on small tables."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_QUANTUM = "CAST('0x' || substr(d, g * 5 + 1, 5) AS INTEGER)"
_BASE32 = "array_to_string(list_transform(range(8), lambda g: " + " || ".join(f"substr({_ALPHABET}, (({_QUANTUM} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)) + "), '')"

WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to, CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN NULL ELSE true END AS verified
FROM p JOIN f USING (d)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

PHRASES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
t AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
g AS (SELECT phrase, min(doc_id) AS first_id FROM t GROUP BY phrase),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM t JOIN g USING (phrase) WHERE first_id < doc_id),
k AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
r AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS n FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.p = k.p GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

BYTES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h WHERE length(x) >= 100)),
g AS (SELECT s, min(doc_id) AS first_id FROM t GROUP BY s HAVING count(*) > 1),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM t JOIN g USING (s) WHERE first_id < doc_id),
n AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM n GROUP BY doc_id, run),
p AS (SELECT r.doc_id, x, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) AS before FROM r JOIN h ON h.doc_id = r.doc_id),
k AS (SELECT doc_id, count(*) AS spans, CAST(sum(hi - lo) AS BIGINT) AS removed, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM p GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN k ON h.doc_id = k.doc_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = w.doc_id
"""
