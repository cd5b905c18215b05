"""SQL for the operators whose rows plain SQL can state: all pairs, by brute force."""

from __future__ import annotations

_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node),
comps AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))  # one byte stands for each, as levenshtein counts bytes
_PLAIN = "".join(c for c in map(chr, range(33, 127)) if not "a" <= c <= "z" and c != "'")[:64]
_CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"""


def _crc(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, beside ``crc_table``."""
    data = f"hex(encode({text}))"
    steps = f"list_transform(range(length({data}) // 2), lambda i: CAST('0x' || substr({data}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), {_UPPER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


ORACLE_SQL = {
    "op2_minhash_dedup": f"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
nodes AS (SELECT doc_id AS id FROM s),
{_COMPONENTS}
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comps ON node = doc_id""",
    "op3_line_dedup": """WITH
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
f AS (SELECT *, trim(regexp_replace(lower(raw), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS form FROM l),
c AS (SELECT form, min((doc_id, line)) AS first, length(form) AS n FROM f WHERE length(form) >= 20 GROUP BY form),
near AS (SELECT DISTINCT b.form FROM c a JOIN c b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.first < b.first AND (left(a.form, 9) = left(b.form, 9) OR right(a.form, 9) = right(b.form, 9)) AND levenshtein(a.form, b.form) <= 1),
g AS (SELECT f.*, c.form IS NOT NULL AND ((f.doc_id, f.line) <> c.first OR c.form IN (SELECT form FROM near)) AS gone FROM f LEFT JOIN c ON f.form = c.form)
SELECT d.doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text FROM documents d JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op3_line_dedup_whole": """WITH
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
f AS (SELECT *, trim(regexp_replace(lower(raw), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS form FROM l),
c AS (SELECT form, min((doc_id, line)) AS first, length(form) AS n FROM f WHERE form <> '' GROUP BY form),
near AS (SELECT DISTINCT b.form FROM c a JOIN c b ON least(a.n, b.n) >= 20 AND a.n BETWEEN b.n - 1 AND b.n + 1 AND a.first < b.first AND (left(a.form, 9) = left(b.form, 9) OR right(a.form, 9) = right(b.form, 9)) AND levenshtein(a.form, b.form) <= 1),
w AS (SELECT form, first, string_split(form, ' ') AS ws FROM c WHERE n >= 20 AND len(string_split(form, ' ')) >= 4),
x AS (SELECT form, first, len(ws) AS k, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
y AS (SELECT form, first, k, i, list_concat(ws[1:i - 1], ws[i + 1:]) AS rest FROM x),
word AS (SELECT b.form FROM y a JOIN y b ON a.k = b.k AND a.i = b.i AND a.rest = b.rest AND a.first < b.first UNION SELECT CASE WHEN w.first < y.first THEN y.form ELSE w.form END FROM y JOIN w ON w.ws = y.rest),
g AS (SELECT f.*, c.form IS NOT NULL AND ((f.doc_id, f.line) <> c.first OR c.form IN (SELECT form FROM near UNION SELECT form FROM word)) AS gone FROM f LEFT JOIN c ON f.form = c.form)
SELECT d.doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text FROM documents d JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op8_embedding_dedup": f"""WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
nodes AS (SELECT vec_id AS id FROM v),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_COMPONENTS},
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comps ON node = vec_id LEFT JOIN n ON n.id = vec_id""",
    "op11_spelling_variants": f"""WITH RECURSIVE
{_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
few AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, k, {_crc("doc_id || ':' || run")} AS h FROM few, crc_table),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_PLAIN}') AS flat FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
pairs AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.flat, b.flat) = 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) AS place FROM pairs),
best AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n FROM words LEFT JOIN ranked ON a = word AND place = 1),
walk(word, last) AS (SELECT word, word FROM best UNION ALL SELECT w.word, b.form FROM walk w JOIN best b ON b.word = w.last WHERE b.form IS NOT NULL)
SELECT b.word, b.form, w.last AS root, b.n, b.n_near, b.form_n FROM best b JOIN walk w ON w.word = b.word JOIN best e ON e.word = w.last AND e.form IS NULL""",
    "op12_conversation_repair": f"""WITH RECURSIVE
{_CRC},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw, range(2) t(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
told AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM told GROUP BY conv_id),
closed(s, e, ins, added) AS (VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
edit(e, op, initial, t, name) AS (VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL), (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')),
way AS (SELECT * FROM closed JOIN edit USING (e)),
path(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])}} FROM counted
  UNION ALL
  SELECT p.conv_id, p.i + 1, w.t, min({{'cost': p.best.cost + 3 * length(w.ins) + CASE w.op WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN w.op <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': p.best.audit || w.ins || w.op,
    'said': list_concat(p.best.said, list_concat(w.added, CASE w.op WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [w.name || ':' || r.text] END))}})
  FROM path p JOIN told r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN way w ON w.s = p.s AND (w.initial IS NULL OR w.initial = r.initial) AND (w.op = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, p.i, w.t),
ended AS (SELECT p.conv_id, min({{'cost': p.best.cost + 3 * length(c.ins), 'audit': p.best.audit || c.ins, 'said': list_concat(p.best.said, c.added)}}) AS best FROM path p JOIN counted n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rows = p.i JOIN closed c ON c.s = p.s AND c.e IN (0, 3) GROUP BY p.conv_id),
all_ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM all_ids a LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_decontaminate": f"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS gram FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k)),
found AS (SELECT g.r, g.p, g.k, w.item FROM grams g JOIN windows w ON w.k = g.k AND w.gram = g.gram),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
