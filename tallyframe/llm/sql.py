"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from tallyframe.llm.quality import STOP_WORDS, THRESHOLDS
from tallyframe.llm.url_filter import RULES, TreeOptions

_MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
    "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
    "bang_ratio": "CASE WHEN n_words > 0 THEN n_bangs / n_words ELSE 0 END",
    "stop_ratio": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END",
    "capital_ratio": "CASE WHEN n_capitals + n_small > 0 THEN n_capitals / (n_capitals + n_small) ELSE 0 END",
    "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    "repeat_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
}


def _passed() -> str:
    tests = []
    for rule in THRESHOLDS:
        value = _MEASURES[rule.measure]
        for bound, sign in ((rule.low, ">="), (rule.high, "<=")):
            if bound is not None:
                tests.append(f"(n_words < {rule.min_words} OR {value} {sign} {bound}::DOUBLE)")
    return " AND ".join(tests) or "TRUE"


def quality() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
),
g AS (
  SELECT rid, i, w[i:i + 4] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM p WHERE len(w) >= 5)
),
again AS (
  SELECT rid, unnest(starts) AS i
  FROM (SELECT rid, gram, list(i) AS starts FROM g GROUP BY rid, gram HAVING count(*) > 1)
),
covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS at FROM again) GROUP BY rid
),
c AS (
  SELECT p.rid, doc_id, len(w)::BIGINT AS n_words,
         length(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_small,
         length(t) - length(replace(t, '!', '')) AS n_bangs,
         len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop
  FROM p LEFT JOIN covered USING (rid)
),
m AS (SELECT *, coalesce(chars, 0) AS word_chars,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_passed()} AS kept
FROM m
"""


def url_filter() -> str:
    """Rules first; other pages by the purity of their template, labelled by the rules."""
    o = TreeOptions()
    rules = sorted(RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, rules)) + " END"
    bad = "CASE " + " ".join(f"WHEN {f} THEN {int(r.action == 'block')}" for f, r in zip(fits, rules)) + " END"
    # The paths of the tables have few segments; SQL unrolls more levels than they reach.
    levels, ends = [], []
    for k in range(1, 9):
        ends.append(f"SELECT page_id, host, path, rule, bad, purity FROM a{k} WHERE seg = '/' OR below < {o.min_rows}")
        levels.append(f"""
s{k} AS MATERIALIZED (SELECT page_id, host, path, rule, bad, parts, branch, coalesce(parts[{k}], '/') AS seg
  FROM a{k - 1} WHERE seg <> '/' AND below >= {o.min_rows}),
c{k} AS MATERIALIZED (SELECT branch, seg, count(*) AS m, count(bad) AS n, sum(coalesce(bad, 0)) AS k FROM s{k} GROUP BY ALL),
t{k} AS MATERIALIZED (SELECT *, CASE WHEN seg = '/' THEN '/'
    WHEN m >= {o.min_rows} AND m >= {o.min_share}::DOUBLE * sum(m) OVER (PARTITION BY branch) THEN seg ELSE '*' END AS t FROM c{k}),
v{k} AS MATERIALIZED (SELECT branch, t, sum(m) AS m, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM t{k} GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT *, lag(n) OVER w AS n0, lag(k) OVER w AS k0 FROM v{k}
  WINDOW w AS (PARTITION BY branch ORDER BY (k + 1) / (n + 2), t)),
p{k} AS MATERIALIZED (SELECT *, (k + k0 + 1) / (n + n0 + 2) AS p FROM b{k}),
f{k} AS MATERIALIZED (SELECT *, coalesce(abs((k + 1) / (n + 2) - (k0 + 1) / (n0 + 2)) > {o.z}::DOUBLE * sqrt(p * (1 - p) * (1 / (n + 2) + 1 / (n0 + 2))), TRUE)::INT AS far
  FROM p{k}),
r{k} AS MATERIALIZED (SELECT *, sum(far) OVER (PARTITION BY branch ORDER BY (k + 1) / (n + 2), t ROWS UNBOUNDED PRECEDING) AS run FROM f{k}),
m{k} AS MATERIALIZED (SELECT branch, t, run, sum(m) OVER r AS below, (sum(k) OVER r + 1) / (sum(n) OVER r + 2) AS purity
  FROM r{k} WINDOW r AS (PARTITION BY branch, run)),
a{k} AS MATERIALIZED (SELECT page_id, host, path, rule, bad, parts, branch || '/' || run AS branch, seg, below, purity
  FROM s{k} JOIN t{k} USING (branch, seg) JOIN m{k} USING (branch, t))""")
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
placed AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rest
),
bare AS (SELECT *, {rule} AS rule, {bad} AS bad, regexp_replace(path, '^/|/+$', '', 'g') AS bare FROM placed),
a0 AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN [] ELSE string_split(bare, '/') END AS parts, host AS branch, '' AS seg, {o.min_rows} AS below
  FROM bare),{','.join(levels)}
SELECT page_id, host, path, rule,
  CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' WHEN purity >= {o.bad_share}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM ({' UNION ALL '.join(ends)})
"""


def prefix_trie() -> str:
    """Plain sums over all (node, ancestor) pairs; crc32 bit by bit."""
    crc_step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: {crc_step}), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.place <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h),
paths AS (
  SELECT i.conv_id, coalesce(list(sha256(length(r.role) || ':' || r.role || r.text) ORDER BY r.part, r.place)
      FILTER (r.place IS NOT NULL), []) AS path,
    coalesce(list(length(r.text) ORDER BY r.part, r.place) FILTER (r.place IS NOT NULL), []) AS points
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
steps AS (
  SELECT conv_id, len(path) AS turns, d AS depth, path[1:d] AS node, points[d] AS points
  FROM paths, unnest(range(len(path) + 1)) AS u(d)),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM steps GROUP BY node),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n.n_convs - 1) * coalesce(n.points, 0) AS own
  FROM nodes n LEFT JOIN children c ON c.node = n.node),
rolled AS (
  SELECT node[1:d] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens
  FROM valued, unnest(range(depth + 1)) AS u(d) GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children,
  r.n_leaves::BIGINT AS n_leaves, r.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN rolled r ON r.node = v.node
LEFT JOIN nodes p ON v.depth > 0 AND p.node = v.node[1:v.depth - 1]
"""
