"""SQL for the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

from .secrets import CLASSES, DIGITS, LOWER, WINDOW

OP1 = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS h FROM documents),
c AS (SELECT doc_id, h, list_filter(string_split(regexp_replace(text, '(\n|[.!?][ \t]+|[。！？])', '\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '') AS cuts FROM d),
l AS (SELECT doc_id, h, unnest(cuts) AS piece, unnest(range(1, len(cuts) + 1)) AS i FROM c),
p AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS a, trim(regexp_replace(lower(nfc_normalize(piece)), '[\x09-\x0D\x20]+', ' ', 'g')) AS n FROM l WINDOW w AS (PARTITION BY doc_id, h ORDER BY i)),
q AS (SELECT *, CASE WHEN n = '' THEN 0 ELSE greatest(length(n) - length(replace(n, ' ', '')) + 1, length(n) // 10) END AS words FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k, row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST, h, a) AS r FROM q WHERE words >= 4),
m AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, h ORDER BY k) AS run FROM k WHERE r > 1),
s AS (SELECT doc_id, h, min(a) AS a, max(a + length(piece)) AS z FROM m GROUP BY doc_id, h, run HAVING sum(words) >= 30),
kept AS (SELECT p.doc_id, p.h, string_agg(piece, '' ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.h = p.h AND p.a >= s.a AND p.a < s.z)) AS text FROM p GROUP BY p.doc_id, p.h),
g AS (SELECT doc_id, h, count(*) AS n, max(z) AS z, string_agg(CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a) AS removed FROM s GROUP BY doc_id, h)
SELECT d.doc_id, coalesce(g.n, 0) AS n_removed, coalesce(removed, '') AS removed,
       CASE WHEN g.n IS NULL THEN d.text WHEN g.z = length(d.text) THEN regexp_replace(coalesce(kept.text, ''), '(\n|[ \t]+)\z', '') ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN g ON g.doc_id = d.doc_id AND g.h = d.h LEFT JOIN kept ON kept.doc_id = d.doc_id AND kept.h = d.h
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, len(e) AS size, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.size = b.size AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""

OP5 = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS k, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM again) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 10 * n_symbols > n_words AND NOT 10 * n_dup_lines > 3 * n_lines AND word_chars BETWEEN 2 * n_words AND 20 * n_words AS kept
FROM m
"""


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """(doc_id, kind, rank, a, z, body): matches and their places, from the pieces between them."""
    p = pattern.replace("'", "''")
    tested = f"regexp_extract_all(text, '{p}', {group})"
    return f"""(SELECT doc_id, '{kind}' AS kind, {rank} AS rank, upto - length(m) AS a, upto AS z, m AS body, g FROM (
        SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest({tested}) AS g, unnest(string_split_regex(text, '{p}')) AS gap, unnest(range(1, len(string_split_regex(text, '{p}')) + 1)) AS i FROM d)
        WHERE m IS NOT NULL) WHERE length(g) >= {least})"""


def _hot(rank: int) -> str:
    c = CLASSES[rank]
    letters = DIGITS + LOWER + LOWER.upper() + "+/_=-"
    repeated = "|".join(f"{'[' + x + ']' if x in '+-' else x}{{8}}" for x in letters)
    return f"""(SELECT doc_id, kind, rank, a, z FROM (
        SELECT doc_id, kind, rank, a, z, j, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS bits FROM (
            SELECT doc_id, kind, rank, a, z, j, ch, count(*) AS n FROM (
                SELECT doc_id, kind, rank, a, z, j, unnest(string_split(substr(body, CAST(j AS BIGINT), {WINDOW}), '')) AS ch FROM (
                    SELECT *, unnest(range(1, length(body) - {WINDOW} + 2)) AS j FROM {_matches(c.kind, 3 + rank, c.run + "{" + str(WINDOW) + ",}", 0, 0)}
                    WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]') AND NOT regexp_matches(body, '(?i)example|sample|dummy|placeholder|0123456789|abcdefghij|qwertyuiop') AND NOT regexp_matches(body, '{repeated}')))
            GROUP BY ALL) GROUP BY doc_id, kind, rank, a, z, j)
        GROUP BY doc_id, kind, rank, a, z HAVING round(max(bits), 9) >= {c.bits})"""


OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, kind, rank, a, z FROM {_matches("assign", 0, '((?i:password|passwd|secret|token|api_?key))["' + "'" + ']?[ ]*[:=][ ]*["' + "'" + ']?([A-Za-z0-9+/_.=-]+)', 2, 12)}
    UNION ALL SELECT doc_id, kind, rank, a, z FROM {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
    UNION ALL SELECT doc_id, kind, rank, a, z FROM {_matches("hex", 2, "[0-9a-f]+", 0, 16)}),
h1 AS (SELECT * FROM {_hot(0)} x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.a < x.z AND x.a < b.z)),
h2 AS (SELECT * FROM {_hot(1)} x WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM h1) b WHERE b.doc_id = x.doc_id AND b.a < x.z AND x.a < b.z)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, rank) AS t FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(t, '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

OP8 = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS rep, count(*) AS n_copies, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT * FROM t WHERE len(ws) > 0),
s AS (SELECT DISTINCT rep, g FROM (SELECT rep, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS g FROM w)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
links AS (SELECT p.a, p.b FROM (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rep <> y.rep GROUP BY 1, 2) p JOIN n na ON na.rep = p.a JOIN n nb ON nb.rep = p.b WHERE 1000 * c >= 800 * (na.n + nb.n - c)),
reach AS (SELECT rep AS a, rep AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE links.a = w.rep) AS n_links, coalesce(w.n_copies, 1) AS n_copies, d.doc_id = coalesce(c.class_id, d.doc_id) AS kept
FROM documents d LEFT JOIN w ON w.text = d.text LEFT JOIN c ON c.a = w.rep
"""

SQL = {"op1_substring_dedup": OP1, "op3_embedding_near_dedup": OP3, "op5_quality_rules": OP5, "op6_secret_scans": OP6, "op8_jaccard_join": OP8}
