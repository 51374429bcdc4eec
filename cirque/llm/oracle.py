"""SQL of the queries that SQL can express: conversation repair and the prefix trie."""

from __future__ import annotations

#: CRC-32 of a text of ASCII characters, bit by bit; xor with all ones before and after.
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
PLACED = "turn NULLS FIRST, role, substr(text, 1, 64), md5(text)"


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _only(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {{'c': 1000000000, 'a': ''}} END"


_CUT, _GO = "CASE WHEN f.cut THEN 3 ELSE 0 END", "NOT f.go"
_INTO_U = [_edit(f"s{q}", f"3 + {_CUT}", "R") for q in (0, 1, 3)]
_ROW = {
    0: _edit("s0", "4", "D"),
    1: _least(_edit("s1", "4", "D"), _only(f"{_GO} AND f.initial = 's'", _edit("s0", _CUT, "K"))),
    2: _least(_edit("s2", "4", "D"), *(_only(_GO, x) for x in _INTO_U), *(_only(f"{_GO} AND f.initial = 'u'", _edit(f"s{q}", _CUT, "K")) for q in (0, 1, 3))),
    3: _least(_edit("s3", "4", "D"), _only(_GO, _edit("s2", f"3 + {_CUT}", "R")), _only(f"{_GO} AND f.initial = 'a'", _edit("s2", _CUT, "K"))),
}

REPAIR = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, role, text, {CRC.format('k')} % 20 AS draw FROM t),
e AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {PLACED}, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, substr(role, 1, 1) AS initial FROM e),
f AS (SELECT *, solid = '' AS blank, solid <> '' AND nth > 1 AS again, solid = '' OR nth > 1 AS go, solid <> '' AND nth = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM o),
n AS (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': 0, 'a': ''}} AS s0, {{'c': 1000000000, 'a': ''}} AS s1, {{'c': 3, 'a': 'I'}} AS s2, {{'c': 6, 'a': 'II'}} AS s3 FROM conversations
 UNION ALL SELECT conv_id, pos, b0, b1, {_least('b2', *(_edit(f'b{q}', '3', 'I') for q in (0, 1, 3)))}, {_least('b3', _edit('b2', '3', 'I'), _edit('b0', '6', 'II'), _edit('b1', '6', 'II'))} FROM (SELECT r.conv_id, f.pos, {', '.join(f'{x} AS b{q}' for q, x in _ROW.items())} FROM r JOIN f ON f.conv_id = r.conv_id AND f.pos = r.pos + 1)),
best AS (SELECT r.conv_id, {_least('s0', 's3')} AS s FROM r LEFT JOIN n USING (conv_id) WHERE r.pos = coalesce(n.rows_, 0)),
l AS (SELECT conv_id, j, substr(s.a, CAST(j AS INT), 1) AS letter FROM (SELECT conv_id, s, unnest(range(1, length(s.a) + 1)) AS j FROM best)),
w AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS pos FROM l),
out_ AS (SELECT w.conv_id, w.letter, row_number() OVER (PARTITION BY w.conv_id ORDER BY j) - 1 AS m, f.role, f.text, f.initial FROM w LEFT JOIN f ON f.conv_id = w.conv_id AND f.pos = w.pos AND w.letter <> 'I' WHERE w.letter <> 'D'),
led AS (SELECT conv_id, max(CASE WHEN m = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS lead FROM out_ GROUP BY 1),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY m) AS body FROM out_ JOIN led USING (conv_id) GROUP BY 1)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256 FROM best b LEFT JOIN n USING (conv_id) LEFT JOIN said USING (conv_id)"""

TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, 64), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {CRC.format('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
x AS (SELECT h.c, t.pos AS p, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h UNION ALL SELECT h.c, t.pos + 10, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
y AS (SELECT c, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS node, length(text) AS len FROM x WINDOW w AS (PARTITION BY c ORDER BY p)),
m AS (SELECT c, 0 AS d, '' AS node, 0 AS len FROM h UNION ALL SELECT c, d, node, len FROM y),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, max(len) AS len, left(node, greatest(length(node) - 32, 0)) AS up FROM m GROUP BY node, d),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT a.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.len) AS saved FROM n a JOIN n b ON starts_with(b.node, a.node) LEFT JOIN k ON k.node = b.node GROUP BY 1),
e AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(node, d) AS node FROM m GROUP BY c) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM n JOIN n p ON p.node = n.up JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN e ON e.node = n.node"""
