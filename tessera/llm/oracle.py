"""Queries of this subpackage in SQL, where SQL can tell their results: by joins of all pairs, for small tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '\\n') || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_ITEM_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item, least(10, len(w)) AS s, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS key FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT s FROM win), pos AS (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, sizes WHERE len(w) >= s),
 hit AS (SELECT doc_id, k, pos.s AS s, item FROM pos JOIN win ON win.s = pos.s AND win.key = array_to_string(w[k:k + pos.s - 1], ' ')),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + s)) AS p FROM (SELECT DISTINCT doc_id, k, s FROM hit)) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

LINES = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
 l AS (SELECT doc_id, k, len(regexp_extract_all(lines[k], '\S+')) AS words FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM d)),
 c AS (SELECT doc_id, k, words, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM l),
 w AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 2
 UNION SELECT b.doc_id, max(a.k), b.k FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 50 GROUP BY 1, b.k),
 r AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY last - first, array_to_string(lines[first:last], chr(10)) ORDER BY doc_id, first) AS n FROM w JOIN d USING (doc_id)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS k FROM r WHERE n > 1),
 runs AS (SELECT doc_id, min(k) AS a, max(k) AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone) GROUP BY doc_id, run),
 told AS (SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n, string_agg((a - 1) || '-' || b, ',' ORDER BY a) AS removed FROM runs GROUP BY 1),
 kept AS (SELECT doc_id, string_agg(lines[k], chr(10) ORDER BY k) AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS kept_text
FROM d LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(_LOWER.format("coalesce(text, '')"))
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
 least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least_ ON d.doc_id = a"""

ORACLE_SQL = {"op2_chat_prefix_tree": CHAT, "op3_benchmark_decontamination": DECONTAMINATION, "op9_line_winnowing": LINES, "op10_ngram_jaccard_join": JACCARD}
