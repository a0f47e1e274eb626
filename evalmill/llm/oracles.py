"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(len(w), 5) - 1), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
f AS (SELECT x AS doc_id, count(*) AS f FROM e GROUP BY x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(c) AS BIGINT) AS component_id,
  CAST(coalesce(max(f.f), 0) AS BIGINT) AS n_links
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""

# the template's own characters in a turn: <s>[INST][/INST]</s>, and a mode and escapes where a control string shows
OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, contains(text, '</s>') OR contains(role, '[/INST]') AS hard,
  length(role || text) AS n, length(regexp_replace(role || text, '[^~<\[]', '', 'g')) AS more FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + n + CASE WHEN hard THEN 1 + more ELSE 0 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
g AS (SELECT r, doc_id, s, md5(array_to_string(list_slice(w, s, s + 12), ' ')) AS win
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 13)) AS p FROM g JOIN m USING (win) WHERE doc_id > lo)),
per AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM (
    SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u ANTI JOIN gone ON gone.r = u.r AND gone.p = u.i GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per ON per.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {0}) {0}"

OP11 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_PLAIN} AS w,
    coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS copy FROM documents),
g AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN copy THEN 'E' END) AS fails FROM t LEFT JOIN g USING (doc_id)),
f AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM d GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM {", ".join(_LETTERS.format(x) for x in "abcde")}
  WHERE list_unique([a, b, c, d, e]) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before,
  translate(fails, filter_order[1:step - 1], '') != fails AS earlier, contains(fails, filter_order[step]) AS own, f.*
  FROM o, (SELECT unnest(range(1, 6)) AS step) n, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter AS filter,
  CAST(sum(CASE WHEN NOT earlier AND NOT own THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT earlier AND own THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN earlier AND own THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT earlier AND own THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT earlier AND own THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(sum(CASE WHEN NOT earlier AND own THEN n ELSE 0 END)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s GROUP BY part, filter_order, step, letter
"""

# CRC-32 of a short decimal text, bit by bit
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP12 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, length(text) AS chars, md5(concat(length(role), ':', role, text)) AS k, turn FROM t),
p AS (SELECT conv_id, chars, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM k),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, k, chars FROM (
  SELECT c.conv_id, 0 AS own, i, k, chars FROM c JOIN p ON p.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, k, chars FROM c JOIN p ON p.conv_id = c.conv_id AND i > h)),
x AS (SELECT conv_id, d, chars, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM x GROUP BY key, d),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (
  SELECT conv_id, max_by(key, d) AS key FROM x GROUP BY conv_id) GROUP BY key),
a AS (SELECT n.*, p.conv_id AS parent FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.key = substr(n.key, 1, 32 * (n.d - 1))),
q AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM a WHERE d > 0 GROUP BY ALL),
b AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN q ON q.parent = a.conv_id AND q.d = a.d),
s AS (SELECT u.key, u.d, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM (SELECT key AS below, d AS dd, unnest(range(0, d + 1)) AS d FROM n) v
  JOIN b ON b.key = v.below AND b.d = v.dd JOIN n u ON u.d = v.d AND u.key = substr(v.below, 1, 32 * v.d) GROUP BY ALL)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(b.d AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
  CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM b JOIN s ON s.key = b.key AND s.d = b.d LEFT JOIN e ON e.key = b.key
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(len(w), 3) - 1), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(c) AS BIGINT) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2, "op3_chat_format": OP3, "op5_decontaminate": OP5, "op7_substring_dedup": OP7, "op11_filter_audit": OP11, "op12_prefix_trie": OP12, "op13_near_dedup": OP13}
