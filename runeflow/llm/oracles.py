"""DuckDB SQL of the corpus operators that SQL can express in reasonable time: all pairs of sets, all windows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE = {
    "op8_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
u AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w),
k AS (SELECT doc_id, n, p, count(*) OVER v AS c, string_agg(word, ' ') OVER v AS g FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM k WHERE c = 4 OR n < 4 AND p = 1),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * b.n >= 80 * (p.n + q.n - b.n)),
m AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS other FROM m UNION SELECT r.doc_id, m.b FROM r JOIN m ON m.a = r.other),
f AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(f.least, w.doc_id) AS component_id, coalesce(f.least, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN z USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op9_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w),
k AS (SELECT doc_id, p, word, count(*) OVER v AS c, md5(string_agg(word, ' ') OVER v) AS h FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, p, word, c = 35 AND count(*) FILTER (c = 35) OVER (PARTITION BY h) > 1 AS again FROM k),
g AS (SELECT doc_id, p, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, len(l) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)""",
}
