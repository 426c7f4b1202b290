"""DuckDB SQL for the queries that SQL can express."""

#: Words as runs without white space, A-Z in lower case, and their shingles.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str) -> str:
    words = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+')"
    return f"SELECT {key}, {words} AS w FROM {table}"


def _shingles(rows: str, key: str) -> str:
    """Different runs of ``width`` words, for rows of key, w and width."""
    return f"""
      SELECT DISTINCT {key}, width, array_to_string(w[i:i + width - 1], ' ') AS s
      FROM (SELECT {key}, w, width, unnest(range(1, greatest(len(w) - width + 2, 1))) AS i FROM ({rows}))"""


DECONTAMINATION = f"""
WITH wide AS (SELECT item_id, w, least(len(w), 5) AS width FROM ({_words('benchmark', 'item_id')}) WHERE len(w) > 0),
items AS ({_shingles('SELECT * FROM wide', 'item_id')}),
sets AS (SELECT item_id, width, list_sort(list(s)) AS l, count(*) AS q FROM items GROUP BY item_id, width),
chosen AS (SELECT min(item_id) AS item_id, any_value(q) AS q FROM sets GROUP BY width, l),
needed AS (SELECT s, width, item_id, q FROM items JOIN chosen USING (item_id)),
docs AS ({_shingles(f"SELECT doc_id, w, width FROM ({_words('documents', 'doc_id')}), (SELECT DISTINCT width FROM wide)", 'doc_id')}),
hits AS (
  SELECT doc_id, item_id FROM docs JOIN needed USING (s, width)
  GROUP BY doc_id, item_id HAVING count(*) * 10 >= any_value(q) * 8)
SELECT d.doc_id, count(h.item_id) AS n_items, coalesce(min(h.item_id), -1) AS item_id, count(h.item_id) > 0 AS contaminated
FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id
"""

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

LINES = r"""
WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS line FROM p),
c AS (SELECT doc_id, line, string_split(regexp_replace(part, '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(10), 'g'), chr(10)) AS parts FROM l),
t AS (SELECT doc_id, line, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM c),
n AS (
  SELECT *, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         line + coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id, line) AS n FROM n WHERE norm <> ''),
u AS (
  SELECT doc_id, line, k, norm FROM k
  UNION ALL SELECT doc_id, line, -1, string_agg(norm, ' ' ORDER BY k) FROM k WHERE n > 1 GROUP BY doc_id, line),
r AS (SELECT doc_id, line, k, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line, k) > 1 AS later, count(*) OVER (PARTITION BY norm) > 1 AS shared FROM u),
f AS (
  SELECT k.*, w.later AS whole, own.later OR w.later AS rep, own.shared OR w.shared AS shared
  FROM k JOIN r own USING (doc_id, line, k) JOIN r w ON w.doc_id = k.doc_id AND w.line = k.line AND w.k = CASE WHEN k.n = 1 THEN 0 ELSE -1 END),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS i FROM f),
i1 AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, rep ORDER BY i) AS g, i - row_number() OVER (PARTITION BY doc_id, shared ORDER BY i) AS gs FROM o),
i2 AS (SELECT *, whole OR (rep AND sum(strlen(norm)) OVER (PARTITION BY doc_id, rep, g) >= 120) AS gone,
              CASE WHEN shared THEN sum(strlen(norm)) OVER (PARTITION BY doc_id, shared, gs) ELSE 0 END AS shared_run FROM i1),
i3 AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS gg, k - row_number() OVER (PARTITION BY doc_id, line, gone ORDER BY k) AS gl FROM i2),
i4 AS (SELECT *, CASE WHEN gone THEN sum(strlen(norm)) OVER (PARTITION BY doc_id, gone, gg) ELSE 0 END AS gone_run FROM i3),
spans AS (
  SELECT doc_id, string_agg(a || '-' || z, ' ' ORDER BY a) AS removed FROM (
    SELECT doc_id, CAST(min(start) AS BIGINT) AS a, CAST(max(start + length(s)) AS BIGINT) AS z FROM i4 WHERE gone GROUP BY doc_id, line, gl) GROUP BY doc_id),
lines AS (
  SELECT n.doc_id, n.line, string_agg(n.s, '' ORDER BY n.pos) FILTER (gone IS NULL OR NOT gone) AS left_,
         count(*) FILTER (norm <> '') > 0 AND coalesce(bool_and(gone) FILTER (norm <> ''), false) AS vanished
  FROM n LEFT JOIN (SELECT doc_id, line, pos, gone FROM i4) g USING (doc_id, line, pos) GROUP BY n.doc_id, n.line),
kept AS (SELECT doc_id, sha256(coalesce(string_agg(coalesce(left_, ''), chr(10) ORDER BY line) FILTER (NOT vanished), '')) AS kept_sha256 FROM lines GROUP BY doc_id),
sums AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, CAST(max(gone_run) AS BIGINT) AS longest_removed,
         CAST(max(shared_run) AS BIGINT) AS longest_shared FROM i4 GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       coalesce(longest_removed, 0) AS longest_removed, coalesce(longest_shared, 0) AS longest_shared, kept_sha256
FROM kept LEFT JOIN sums USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: crc32 by a table of its 256 steps; nodes are named by the texts of their turns.
TRIE = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, own, c - ((c % 20) + 20) % 20 AS base, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT c, max(pos) AS own FROM t GROUP BY c), tab),
l AS (
  SELECT k.c, k.h, k.base, least(k.h, coalesce(b.own, 0)) AS lent, least(k.h, coalesce(b.own, 0)) + greatest(k.own - k.h, 0) AS n
  FROM k LEFT JOIN k b ON b.c = k.base),
u AS (
  SELECT l.c, t.pos - h + lent AS d, r, x FROM l JOIN t ON t.c = l.c WHERE pos > h
  UNION ALL SELECT l.c, pos, r, x FROM l JOIN t ON t.c = l.base WHERE pos <= lent),
named AS (
  SELECT c, d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
         string_agg(md5(length(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM u
  UNION ALL SELECT c, 0, 0, '' FROM l),
p AS (SELECT c, d, w, path, lag(path) OVER (PARTITION BY c ORDER BY d) AS above FROM named),
nodes AS (SELECT path, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(w) AS saved, min(above) AS above FROM p GROUP BY path),
kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM p JOIN l USING (c) WHERE d = n GROUP BY path),
under AS (
  SELECT p.path, sum(saved) AS saved_tokens, count(*) FILTER (kids.path IS NULL) AS n_leaves
  FROM nodes LEFT JOIN kids USING (path) JOIN p ON p.c = conv_id AND p.d <= depth GROUP BY p.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN under USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes up ON up.path = n.above
"""

ORACLES = {
    "op4_decontamination": DECONTAMINATION,
    "op6_exact_dedup": EXACT,
    "op9_line_dedup": LINES,
    "op10_chat_format": CHAT,
    "op11_prefix_trie": TRIE,
}
