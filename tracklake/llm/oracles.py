"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import licences

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least vertex that links reach, for links (a, b) in both directions and vertices (v).
REACHED = "reached(v, r) AS (SELECT v, v FROM vertices UNION SELECT l.b, reached.r FROM reached JOIN links l ON l.a = reached.v), roots AS (SELECT v, min(r) AS root FROM reached GROUP BY v)"

#: Every byte of every document, whether a 50-byte string that starts in an earlier document covers it.
SUFFIXES = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, hx, n, unnest(range(n)) AS p FROM docs WHERE n > 0),
strings AS (SELECT doc_id, n, p, substr(hx, 2 * p + 1, 2) AS b, CASE WHEN p + 50 <= n THEN substr(hx, 2 * p + 1, 100) END AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS d FROM strings WHERE s IS NOT NULL GROUP BY s),
starts AS (SELECT t.doc_id, t.p, t.b, CASE WHEN f.d < t.doc_id THEN t.p END AS c FROM strings t LEFT JOIN firsts f ON t.s = f.s),
latest AS (SELECT doc_id, p, b, max(c) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS c FROM starts),
marked AS (SELECT doc_id, p, b, coalesce(p - c < 50, false) AS gone FROM latest),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS edge FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256 FROM edged GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS x, b.n AS y, count(*) AS k FROM members a JOIN members b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (x + y - k)), vertices AS (SELECT doc_id AS v FROM documents), {REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN roots ON v = doc_id
"""

VECTORS = f"""
WITH RECURSIVE found AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM found WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
vertices AS (SELECT vec_id AS v FROM embeddings), {REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN roots ON v = vec_id
"""

ORACLE_SQL = {"op1_licences": licences.oracle(), "op2_suffixes": SUFFIXES, "op3_minhash": NEAR, "op7_embeddings": VECTORS}
