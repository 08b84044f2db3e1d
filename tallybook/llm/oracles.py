"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

WARC = """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f ON p.digest = f.digest"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.len > 0 AND b.len > 0
  AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) >= 0.93 * a.len * b.len),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id"""

MIXING = """WITH RECURSIVE n AS (SELECT '=' || source AS key, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT key, n, (n + 63) // 64 AS blocks, CAST(greatest(1, round(sqrt(n) * 1024)) AS BIGINT) AS weight FROM n),
t AS (SELECT CAST(sum(weight) AS BIGINT) AS total FROM s), one AS (SELECT list(key ORDER BY key) AS keys, list(weight ORDER BY key) AS w, any_value(total) AS total, least(any_value(total), max(CAST(ceil(blocks * total / weight) AS BIGINT) + 1)) AS span FROM s, t),
edf AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS lag, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS turn FROM one
  UNION ALL SELECT slot, list_transform(lag, lambda x, i: x - CASE WHEN i = k THEN total ELSE 0 END), list_transform(done, lambda x, i: x + CASE WHEN i = k THEN 1 ELSE 0 END), k, done[k] FROM (SELECT slot, lag, done, total,
    list_sort(list_filter(list_transform(list_zip(lag, w), lambda z, i: [CAST(z[1] > 0 AS BIGINT), (total - z[1] + z[2] - 1) // z[2], i]), lambda b: b[1] = 1))[1][3] AS k
    FROM (SELECT slot + 1 AS slot, list_transform(list_zip(lag, w), lambda z: z[1] + z[2]) AS lag, done, w, total FROM edf, one WHERE slot + 1 < span) p) q),
r AS (SELECT keys[pick] AS key, turn, slot, span, CASE WHEN span = total THEN w[pick] ELSE 1099511627776 END AS share FROM edf, one WHERE slot >= 0),
d AS (SELECT doc_id, source, '=' || source AS key, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number FROM documents),
b AS (SELECT doc_id, source, number // 64 AS block, number, r.span * ((number // 64) // r.share) + r.slot AS slot FROM d JOIN r ON d.key = r.key AND (number // 64) % r.share = r.turn)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, CAST(row_number() OVER (ORDER BY slot, number) - 1 AS BIGINT) AS position FROM b"""

EXACT = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256 FROM t WINDOW g AS (PARTITION BY norm)"""

PHRASES = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) l(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.k, a, x.f AS l, y.f AS r, j, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first AND x.k = j JOIN f y ON y.lang = cut.lang AND y.phrase = rest AND y.k = cut.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, inner_phrase, max(a) AS f FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS inner_phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN around ON around.lang = b.lang AND around.inner_phrase = b.phrase AND b.k = 2 WHERE coalesce(100 * around.f < 50 * b.a, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""
