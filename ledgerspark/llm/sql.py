"""SQL counterparts that need more than a few lines."""

from __future__ import annotations

#: The 256 remainders of CRC-32 as the list `crc`, made by its rule.
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS numbers(i))"""


def crc32(octets: str) -> str:
    """CRC-32 of a list of byte values, where `crc_table` is joined."""
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


TURNS = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS mark
  FROM conversations),
ways AS (SELECT given.*, {crc32("list_transform(string_split(mark, ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 20 AS way FROM given, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM ways JOIN (VALUES (1), (2)) AS times(n) ON n = 1 OR way = 3
  WHERE way <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM hurt),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS is_repeat,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut, left(lag(role) OVER (PARTITION BY conv_id ORDER BY r), 1) || left(role, 1) AS pair
  FROM numbered),
seen AS (SELECT *, is_blank OR is_repeat AS must_go FROM judged),
inserts(x, z, edits, lines) AS (
  VALUES ('-', '-', '', ''), ('-', 'u', 'I', 'user:' || chr(10)), ('-', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         ('s', 's', '', ''), ('s', 'u', 'I', 'user:' || chr(10)), ('s', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         ('a', 'a', '', ''), ('a', 'u', 'I', 'user:' || chr(10)), ('a', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         ('u', 'u', '', ''), ('u', 'a', 'I', 'assistant:' || chr(10)), ('u', 'u', 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
ops(z, y, op, price, initial, role) AS (
  VALUES ('-', '-', 'D', 4, NULL, NULL), ('s', 's', 'D', 4, NULL, NULL), ('u', 'u', 'D', 4, NULL, NULL), ('a', 'a', 'D', 4, NULL, NULL),
         ('-', 's', 'K', 0, 's', NULL), ('-', 'u', 'K', 0, 'u', NULL), ('s', 'u', 'K', 0, 'u', NULL), ('a', 'u', 'K', 0, 'u', NULL), ('u', 'a', 'K', 0, 'a', NULL),
         ('-', 'u', 'R', 3, NULL, 'user'), ('s', 'u', 'R', 3, NULL, 'user'), ('a', 'u', 'R', 3, NULL, 'user'), ('u', 'a', 'R', 3, NULL, 'assistant')),
moves AS (
  SELECT x, y, op, initial, ops.role, edits || op AS edits, lines, price + 3 * length(edits) AS price FROM inserts JOIN ops USING (z)),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, '-' AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM seen) AS each_one
  UNION ALL
  SELECT p.conv_id, p.r + 1, m.y,
         min({{'cost': p.best.cost + m.price + CASE WHEN m.op <> 'D' AND w.is_cut THEN 3 ELSE 0 END, 'audit': p.best.audit || m.edits,
               'lines': p.best.lines || m.lines || CASE WHEN m.op = 'D' THEN '' ELSE coalesce(m.role, w.role) || ':' || w.text || chr(10) END}})
  FROM paths AS p JOIN seen AS w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.r = p.r + 1
  JOIN moves AS m ON m.x = p.state AND (m.op = 'D' OR NOT w.must_go) AND (m.initial IS NULL OR m.initial = left(w.role, 1))
  GROUP BY p.conv_id, p.r, m.y),
sums AS (
  SELECT conv_id, max(r) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
         count(*) FILTER (is_repeat AND NOT is_blank) AS duplicate, count(*) FILTER (is_cut AND NOT must_go) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM seen GROUP BY conv_id),
ends AS (
  SELECT s.conv_id, min({{'cost': p.best.cost + 3 * length(i.edits), 'audit': p.best.audit || i.edits, 'lines': p.best.lines || i.lines}}) AS best
  FROM sums AS s JOIN paths AS p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.r = s.n JOIN inserts AS i ON i.x = p.state AND i.z IN ('-', 'a')
  GROUP BY s.conv_id)
SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(left(e.best.lines, length(e.best.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN sums AS s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY ALL),
octets AS (
  SELECT run, n, flatten(list_transform(string_split(mark, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
  FROM runs),
hashed AS (SELECT run, n, {crc32("bytes")} AS h FROM octets, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
shorter AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM words, range(1, length(word) + 1) AS places(i)),
links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter AS a JOIN shorter AS b USING (less, i) WHERE a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter AS s JOIN words AS w ON w.word = s.less
  UNION SELECT w.word, s.word, s.n FROM shorter AS s JOIN words AS w ON w.word = s.less),
near AS (SELECT word, count(*) AS n_near, min({{'n': -other_n, 'word': other}}) AS best FROM links GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.word END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n
  FROM words AS w LEFT JOIN near USING (word)),
chains AS (SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chains AS c JOIN forms AS f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains AS c JOIN forms AS f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms AS f JOIN ends USING (word)"""
