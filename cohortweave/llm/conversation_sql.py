"""DuckDB SQL for the registered queries over ``conversations``, written from their definitions."""

from __future__ import annotations


def _crc32_table() -> str:
    """The 256 remainders of the reflected CRC-32 polynomial, as an SQL list."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(str(value))
    return "[" + ", ".join(table) + "]"


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text; needs the column ``t`` of the view ``crc``."""
    return (
        f"(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), "
        f"lambda i: ord(substr({text}, i, 1))::BIGINT)), "
        "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295))"
    )


def _cheapest(*ways: str) -> str:
    """The least (cost, letters) of the ways; null where there is none."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _way(state: str, cost: str, letters: str, turns: str, allowed: str) -> str:
    """A way on from a state: more cost, letters and repaired turns."""
    return (
        f"CASE WHEN {state} IS NOT NULL AND {allowed} THEN struct_pack("
        f"c := {state}.c + {cost}, a := {state}.a || '{letters}', t := list_concat({state}.t, {turns})) END"
    )


def _step() -> dict[str, str]:
    """The best way to each state after one more row."""
    stays, extra = "NOT d.must_go", "d.extra"
    own, user, assistant = "[d.role || ':' || d.text]", "['user:' || d.text]", "['assistant:' || d.text]"
    none = "list_value()::VARCHAR[]"
    ways: dict[str, list[str]] = {}
    for state in ("q0", "q1", "q2", "q3"):
        s = f"p.{state}"
        ways[state] = [_way(s, "3", "D", none, "true")]
    ways["q1"].append(_way("p.q0", extra, "K", own, f"{stays} AND d.initial = 's'"))
    for state in ("q0", "q1", "q3"):
        s = f"p.{state}"
        ways["q2"].append(_way(s, extra, "K", own, f"{stays} AND d.initial = 'u'"))
        ways["q2"].append(_way(s, f"{extra} + 2", "R", user, stays))
        ways["q3"].append(_way(s, f"{extra} + 2", "IK", f"['user:', d.role || ':' || d.text]", f"{stays} AND d.initial = 'a'"))
        ways["q3"].append(_way(s, f"{extra} + 4", "IR", "['user:', 'assistant:' || d.text]", stays))
    s = "p.q2"
    ways["q3"].append(_way(s, extra, "K", own, f"{stays} AND d.initial = 'a'"))
    ways["q3"].append(_way(s, f"{extra} + 2", "R", assistant, stays))
    ways["q2"].append(_way(s, f"{extra} + 2", "IK", f"['assistant:', d.role || ':' || d.text]", f"{stays} AND d.initial = 'u'"))
    ways["q2"].append(_way(s, f"{extra} + 4", "IR", "['assistant:', 'user:' || d.text]", stays))
    return {state: _cheapest(*w) for state, w in ways.items()}


_EMPTY = "struct_pack(c := 0::BIGINT, a := '', t := list_value()::VARCHAR[])"
_STEP = _step()
_END = _cheapest(
    _way("q0", "0", "", "list_value()::VARCHAR[]", "true"),
    _way("q1", "4", "II", "['user:', 'assistant:']", "true"),
    _way("q2", "2", "I", "['assistant:']", "true"),
    _way("q3", "0", "", "list_value()::VARCHAR[]", "true"),
)

REPAIR_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_crc32_table()}::BIGINT[] AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), drawn AS (SELECT *, {crc32("k")} % 20 AS draw FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS is_cut
  FROM damaged
), d AS (
  SELECT *, left(role, 1) AS initial, is_blank OR nth > 1 AS must_go,
    CASE WHEN NOT is_blank AND nth = 1 AND is_cut THEN 1::BIGINT ELSE 0::BIGINT END AS extra
  FROM placed
), p AS (
  SELECT conv_id, 0::BIGINT AS pos, {_EMPTY} AS q0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS q1,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS q2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS q3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, d.pos, {", ".join(_STEP[q] for q in ("q0", "q1", "q2", "q3"))}
  FROM p JOIN d ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND d.pos = p.pos + 1
), ended AS (
  SELECT conv_id, {_END} AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), pairs AS (
  SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM d
), wrong AS (
  SELECT conv_id, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND nth > 1) AS duplicate,
    count(*) FILTER (NOT is_blank AND nth = 1 AND is_cut) AS truncated
  FROM d GROUP BY conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(w.illegal, 0) AS illegal, e.best.c AS cost, e.best.a AS audit,
  sha256(array_to_string(e.best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN wrong w ON e.conv_id IS NOT DISTINCT FROM w.conv_id
"""

TRIE_SQL = f"""
WITH crc AS (SELECT {_crc32_table()}::BIGINT[] AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(r)::VARCHAR || ':' || r || x)) AS place, struct_pack(r := r, x := x) AS turn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list(turn ORDER BY place) AS turns FROM turns GROUP BY conv_id
), drawn AS (
  SELECT conv_id, turns, {crc32("k")} % 4 AS h
  FROM (SELECT *, CAST(conv_id AS VARCHAR) AS k FROM own), crc
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(o.turns, list_value())[1:d.h], d.turns[d.h + 1:]) AS turns
  FROM drawn d LEFT JOIN own o ON o.conv_id = d.conv_id - d.conv_id % 20
), starts AS (
  SELECT conv_id, depth, turns[1:depth] AS node, depth = len(turns) AS is_end
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM starts GROUP BY node, depth
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(
      regexp_split_to_array(n.node[depth].x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS saved
  FROM nodes n LEFT JOIN children c ON n.node = c.node
), below AS (
  SELECT node[1:up] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON c.node = b.node
  LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1:c.depth - 1]
"""
