"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Only the words' own separators count, and every window's start is looked up by the words themselves.
ORACLES["op3_recompression"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest([array_to_string(w[j:j+34], ' ') FOR j IN range(1, len(w) - 33)]) AS k FROM d WHERE len(w) >= 35),
m AS (SELECT md5(k) AS k FROM s GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + o AS p FROM s SEMI JOIN m ON md5(s.k) = m.k, range(35) t(o)),
g AS (SELECT r, list(p) AS gone FROM hit GROUP BY r),
kept AS (SELECT d.r, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d ANTI JOIN hit ON d.r = hit.r AND d.p = hit.p GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

ORACLES["op5_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), '')) + length(role) - length(replace(role, '#', '')) - len(regexp_extract_all(role, '#+')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
  + length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 13 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op8_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i+9], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT r, i, s.n, item FROM s JOIN p ON s.n = p.n AND s.k = p.k),
h AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM f, range(10) t(o) WHERE o < f.n GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

ORACLES["op6_itq"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([e IS NOT NULL AND isfinite(e) FOR e IN embedding]) AND list_bool_or([e <> 0 FOR e IN embedding])),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id
"""

# Bytes as pairs of hex digits. Later copies' starts form islands of windows that touch; what lies between islands is kept.
ORACLES["op4_bwt_merge"] = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
l AS (SELECT r, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM s) WHERE n > 1 WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, sum(least(100, coalesce(after - i, 100)))::BIGINT AS n_removed, list(i ORDER BY i) FILTER (before IS NULL OR i > before + 100) AS a, list(i + 100 ORDER BY i) FILTER (after IS NULL OR after > i + 100) AS b FROM l GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string([substr(h, 2 * coalesce(b[j - 1], 0) + 1, 2 * (coalesce(a[j], len(h) // 2) - coalesce(b[j - 1], 0))) FOR j IN range(1, len(a) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
