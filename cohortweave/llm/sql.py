"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from cohortweave.llm import license_scan
from cohortweave.llm import secret_scan as ss
from cohortweave.llm.conversation_sql import REPAIR_SQL, TRIE_SQL
from cohortweave.llm.url_reputation import DOUBLE_SUFFIXES, LOWER, RULES, UPPER

QUALITY_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS n FROM win) WHERE n > 1
), pos AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(pos.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN pos ON w.rid = pos.rid
), f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 0 AND 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 32 ELSE 0 END
    AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed
FROM f
"""

def _shrunk(name: str, groups: str, n: str, bad: str, parent: str) -> str:
    """Two steps: the fitted strength of a level's prior, and its groups shrunk by it."""
    return f"""
{name}_m AS (
  SELECT sum(pow({bad} - {n} * {parent}, 2) / {n}) AS spread, sum({parent} * (1 - {parent})) AS alone,
    sum({parent} * (1 - {parent}) * ({n} - 1)) AS together
  FROM {groups} WHERE {n} > 0
), {name}_k AS (
  SELECT round(1 / CASE WHEN coalesce(together, 0) = 0 THEN 0.5
    ELSE least(greatest((spread - alone) / together, 0.001), 0.5) END - 1, 6) AS k FROM {name}_m
), {name} AS (
  SELECT *, ({bad} + k * {parent}) / ({n} + k) AS mean, {n} + k AS weight FROM {groups}, {name}_k
)"""


_DOUBLE = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)
_RULE_ROWS = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)

URL_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), o AS (
  SELECT doc_id, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS is_bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL
), h0 AS (
  SELECT host, CAST(count(is_bad) AS DOUBLE) AS n, CAST(count(*) FILTER (is_bad) AS DOUBLE) AS bad
  FROM s LEFT JOIN o ON page_id = doc_id GROUP BY host
), h1 AS (
  SELECT *, string_split(regexp_extract(host, '^[^:]*'), '.') AS l FROM h0
), h2 AS (
  SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({_DOUBLE}) THEN 2 ELSE 1 END AS w FROM h1
), h AS (
  SELECT host, n, bad, array_to_string(l[-(w + 1):], '.') AS domain,
    CASE WHEN len(l) > w THEN array_to_string(l[-w:], '.') ELSE '' END AS suffix
  FROM h2
), d AS (
  SELECT domain, suffix, sum(n) AS n_d, sum(bad) AS bad_d FROM h GROUP BY domain, suffix
), f AS (
  SELECT suffix, sum(n_d) AS n_s, sum(bad_d) AS bad_s, (sum(sum(bad_d)) OVER () + 1) / (sum(sum(n_d)) OVER () + 2) AS mean_0
  FROM d GROUP BY suffix
),{_shrunk("f1", "f", "n_s", "bad_s", "mean_0")}, d0 AS (
  SELECT d.*, f1.mean AS mean_s FROM d JOIN f1 USING (suffix)
),{_shrunk("d1", "d0", "n_d", "bad_d", "mean_s")}, g0 AS (
  SELECT h.host, h.n, h.bad, d1.mean AS mean_d FROM h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix
),{_shrunk("g1", "g0", "n", "bad", "mean_d")}, blocked AS (
  SELECT host FROM g1 WHERE host <> '' AND mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5
), rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}
), best AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM s JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rid
)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN best USING (rid)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"{_quoted(s)}: {_quoted(i)}" for s, i in license_scan.known_sentences())


def _sentence_ids(line_end: str) -> str:
    return rf"""list_filter(list_transform(string_split(regexp_replace(
      regexp_replace(text, '\s*\n\s*', {line_end}, 'g'), '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)),
      lambda s: MAP {{{_KNOWN}}}[regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g'), '(^[. ]+|[. ]+$)', '', 'g')]),
      lambda i: i IS NOT NULL)"""


def _license_names() -> str:
    """(rid, name) of every chain of rules: a queue per place, served by the next sentence of the chain.

    What has been served up to a position is all services so far less the most that had found the queue empty.
    """
    found = []
    for whole, rules in license_scan.chains():
        steps = f"SELECT *, count(*) FILTER (id = '{whole[0]}') OVER w AS a1 FROM x WHERE id IN ({_listed(whole)}) {_W}"
        for i, sentence in enumerate(whole[1:], 2):
            steps = f"SELECT *, count(*) FILTER (id = '{sentence}') OVER w AS s{i} FROM ({steps}) {_W}"
            steps = f"SELECT *, s{i} + least(0, min(a{i - 1} - s{i}) OVER w) AS a{i} FROM ({steps}) {_W}"
        longer = "0"
        for rule in rules:
            held = f"max(a{len(rule.sentences)})"
            found.append(f"SELECT rid, '{rule.license}' AS name FROM ({steps}) GROUP BY rid HAVING {held} > {longer}")
            longer = held
    return " UNION ALL ".join(found)


def _listed(values) -> str:
    return ", ".join(_quoted(v) for v in values)


_W = "WINDOW w AS (PARTITION BY rid ORDER BY pos)"
LICENSE_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT rid, doc_id, {_sentence_ids("chr(10)")} AS by_line, {_sentence_ids("' '")} AS across FROM t
), r AS (
  SELECT rid, doc_id, CASE WHEN len(by_line) >= len(across) THEN by_line ELSE across END AS ids FROM b
), x AS (
  SELECT rid, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM r
), named AS (
  SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM ({_license_names()}) GROUP BY rid
)
SELECT doc_id, coalesce(licenses, '') AS licenses, array_to_string(ids, ',') AS sentences
FROM r LEFT JOIN named USING (rid)
"""

def _class_logs(name: str, label: str) -> str:
    """Smoothed log chance of each pair in one class of samples."""
    return f"""
{name}_n AS (
  SELECT a.c AS a, b.c AS b, coalesce(n, 0) AS n
  FROM letters a CROSS JOIN letters b LEFT JOIN pair_counts p ON p.pair = a.c || b.c AND p.is_random = {label}
), {name}_s AS (
  SELECT b, sum(n) + 1 AS single, sum(sum(n) + 1) OVER () AS total FROM {name}_n GROUP BY b
), {name}_w AS (
  SELECT a, {name}_n.b, n + {ss.SMOOTHING} * (single / total) AS w FROM {name}_n JOIN {name}_s USING (b)
), {name} AS (
  SELECT a, b, ln(w / sum(w) OVER (PARTITION BY a)) AS l FROM {name}_w
)"""


def _kind_spans(place: int, pattern: str) -> str:
    return f"""
SELECT rid, {place} AS k, list_sum(list_transform(parts[1 : j - 1], lambda p: length(p))) AS s, parts[j] AS m
FROM (SELECT rid, parts, unnest(range(2, len(parts) + 1, 2)) AS j
  FROM (SELECT rid, string_split(regexp_replace(plain, {_quoted("(" + pattern + ")")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts
    FROM t))"""


_KINDS = "[" + ", ".join(_quoted(k) for k in ss.KINDS) + "]"

SECRET_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, text, replace(coalesce(text, ''), chr(1), chr(2)) AS plain FROM documents
), sample AS (
  SELECT rid, text FROM t WHERE text IS NOT NULL AND md5(CAST(doc_id AS VARCHAR)) <= (
    SELECT max(k) FROM (SELECT md5(CAST(doc_id AS VARCHAR)) AS k FROM t
      WHERE text IS NOT NULL AND doc_id IS NOT NULL ORDER BY k LIMIT {ss.TRAINING_DOCUMENTS}))
), samples AS (
  SELECT true AS is_random, unnest(list_distinct(
    list_filter(regexp_extract_all(text, {_quoted(ss.ASSIGN)}, 1), lambda v: length(v) >= {ss.ASSIGN_LENGTH})
    || regexp_extract_all(text, '{ss.ACCESS}') || regexp_extract_all(text, '{ss.HEX}'))) AS sample FROM sample
  UNION ALL
  SELECT false, unnest(list_distinct(regexp_extract_all(regexp_replace(
    regexp_replace(text, {_quoted(ss.ASSIGN)}, ' ', 'g'), '{ss.ACCESS}|{ss.HEX}', ' ', 'g'), '{ss.IDENTIFIER}'))) FROM sample
), pair_counts AS (
  SELECT is_random, pair, count(*) AS n
  FROM (SELECT is_random, substr(sample, unnest(range(1, length(sample))), 2) AS pair FROM samples)
  GROUP BY is_random, pair
), letters AS (
  SELECT substr('{ss.ALPHABET}', i, 1) AS c FROM range(1, {len(ss.ALPHABET) + 1}) r(i)
),{_class_logs("random", "true")},{_class_logs("ordinary", "false")}, ratios AS (
  SELECT random.a || random.b AS pair, round(random.l - ordinary.l, 6) AS r
  FROM random JOIN ordinary ON random.a = ordinary.a AND random.b = ordinary.b
), raw AS (
  {" UNION ALL ".join(_kind_spans(i, p) for i, p in enumerate((ss.ASSIGN, ss.ACCESS, ss.HEX, ss.CANDIDATE)))}
), scores AS (
  SELECT rid, s, sum(r) AS score
  FROM (SELECT rid, s, substr(m, unnest(range(1, length(m))), 2) AS pair FROM raw WHERE k = 3) JOIN ratios USING (pair)
  GROUP BY rid, s
), spans AS (
  SELECT rid, k, s, s + length(m) AS e FROM raw LEFT JOIN scores USING (rid, s)
  WHERE CASE k
    WHEN 0 THEN length(regexp_extract(m, {_quoted(ss.ASSIGN)}, 1)) >= {ss.ASSIGN_LENGTH}
    WHEN 3 THEN score >= {ss.LEAST_RATIO} AND score >= {ss.LEAST_PER_PAIR} * (length(m) - 1)
    ELSE true END
), listed AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS fixed, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM (SELECT *, {_KINDS}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM spans)
  GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(fixed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed USING (rid)
"""

ORACLES = {
    "op1_url_reputation": URL_SQL,
    "op2_secret_scan": SECRET_SQL,
    "op3_license_scan": LICENSE_SQL,
    "op5_quality_rules": QUALITY_SQL,
    "op11_turn_repair": REPAIR_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
