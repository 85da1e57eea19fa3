"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .merkle import FANOUT
from .mixing import MAX_COUNT, MAX_MEAN
from .quality_rules import DELTA, MAX_FALSE_REJECTION, MIN_WORDS as MIN_TEXT_WORDS, RULES, STEPS
from .parameters import LISTED_DOMAINS, URL_RULES

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    scores = " UNION ALL ".join(
        f"SELECT doc_id, lang, quality, '{r.name}' AS rule, {r.score} AS score FROM holdouts" for r in RULES)
    ladders = " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, j, {r.start}::DOUBLE + {r.step}::DOUBLE * j AS cutoff FROM range({STEPS}) t(j)"
        for r in RULES)
    rejects = " UNION ALL ".join(
        f"SELECT s.doc_id FROM passed s JOIN chosen c ON s.lang = c.lang AND c.rule = '{r.name}' "
        f"WHERE {r.score} > c.cutoff" for r in RULES)
    share, rules = f"({MAX_FALSE_REJECTION}::DOUBLE / {len(RULES)})", len(RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM docs),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(ls) AS l FROM worded) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM worded d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines USING (doc_id)),
based AS (
  SELECT *, n_words < {MIN_TEXT_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
passed AS (SELECT * FROM based WHERE NOT base_failed),
holdouts AS (
  SELECT p.*, quality FROM passed p
  JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
scores AS ({scores}),
ladders AS ({ladders}),
walked AS (
  SELECT lang, s.rule, j, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality <> 1) AS n_bad,
         count(*) FILTER (quality = 1 AND score > cutoff) AS k, count(*) FILTER (quality <> 1 AND score > cutoff) AS k_bad
  FROM scores s JOIN ladders l ON s.rule = l.rule GROUP BY ALL),
tested AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i:
              exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) AS p
  FROM walked WHERE n > 0 AND n_bad > 0 AND k <= n * {share} + 1),
gains AS (
  SELECT lang, rule, j, cutoff, k_bad / n_bad::DOUBLE - k / n::DOUBLE AS gain FROM tested
  WHERE p <= {DELTA}::DOUBLE / ({rules} * (SELECT count(DISTINCT lang) FROM holdouts))),
chosen AS (
  SELECT lang, rule, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, j) AS o FROM gains WHERE gain > 0)
  WHERE o = 1),
rejected AS (SELECT DISTINCT doc_id FROM ({rejects}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM based"""


def exact_dedup_sql() -> str:
    return f"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code_points,
         sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256, n_code_points
FROM base
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_code_points DESC, doc_id)"""


def line_dedup_sql() -> str:
    return f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
counted AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '{WORD}') AS ws FROM lines),
formed AS (
  SELECT *, len(ws) >= 1 AS counted, array_to_string(ws, ' ') AS form FROM counted),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY counted, form ORDER BY doc_id, i) AS occurrence FROM formed),
forms AS (
  SELECT form, ws, doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS pos
  FROM ranked WHERE len(ws) >= {MIN_WORDS} AND occurrence = 1),
cuts AS (
  SELECT pos, ws, form, unnest(range(1, len(ws) + 1)) AS k FROM forms),
variants AS (
  SELECT pos, k, len(ws) AS n,
         array_to_string(list_concat(list_slice(ws, 1, k - 1), list_slice(ws, k + 1, len(ws))), ' ') AS v
  FROM cuts),
near AS (
  SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, k, v) AS lead FROM variants) WHERE lead < pos
  UNION
  SELECT v.pos FROM variants v JOIN forms f ON f.form = v.v WHERE f.pos < v.pos
  UNION
  SELECT f.pos FROM variants v JOIN forms f ON f.form = v.v WHERE v.pos < f.pos),
marked AS (
  SELECT r.*, counted AND occurrence > 1 AS is_exact, n.pos IS NOT NULL AND counted AND occurrence = 1 AS is_near
  FROM ranked r LEFT JOIN forms f ON r.doc_id = f.doc_id AND r.i = f.i LEFT JOIN near n ON n.pos = f.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_exact) AS n_exact, count(*) FILTER (is_near) AS n_near,
       bool_or(is_exact OR is_near) AND coalesce(sum(len(ws)) FILTER (NOT is_exact AND NOT is_near), 0) = 0 AS emptied,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_exact AND NOT is_near), '') AS text
FROM marked GROUP BY doc_id"""


def mix_sources_sql(alpha: float = 0.5, epochs: float = 1.0, seed: int = 9) -> str:
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS all_n, sum(pow(n, {alpha})) AS weight FROM counts),
rates AS (SELECT source, ({epochs} * all_n / weight) * pow(n, {alpha}) / n AS rate FROM counts, totals),
means AS (SELECT source, greatest(1, ceil(rate / {MAX_MEAN}))::INT AS draws,
                 rate / greatest(1, ceil(rate / {MAX_MEAN})) AS mean FROM rates),
terms AS (
  SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k + 1 < {MAX_COUNT}),
sides AS (SELECT source, draws, list(c ORDER BY k) AS cdf FROM terms GROUP BY source, draws),
drawn AS (
  SELECT d.*, s.draws, s.cdf, unnest(range(1, s.draws + 1)) AS i
  FROM documents d JOIN sides s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, len(list_filter(cdf, lambda c: c <=
           ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i::VARCHAR), 1, 13))::BIGINT
           / {float(1 << 52)!r})) AS c FROM drawn),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, sum(c)::INT AS n_copies FROM counted GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INT AS copy_no, n_copies
FROM copies WHERE n_copies > 0"""


def url_filter_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r.name), -len(r.host)))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules}
    names = " ".join(f"WHEN {fits[r]} THEN '{r.name}'" for r in rules)
    verdicts = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in rules)
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED_DOMAINS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                       ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, CASE {names} END AS rule,
       CASE {verdicts} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


def _folds(name: str, levels: int) -> str:
    """CTEs that fold the trees of <name>0 (tree, r, d, n): <name>1, ..., and their runs <name>_runs0, ..."""
    return ",".join(f"""
{name}_runs{k} AS (
  SELECT tree, r // {FANOUT} AS r, list(d ORDER BY r) AS ds, any_value(n) AS n FROM {name}{k} GROUP BY tree, r // {FANOUT}),
{name}{k + 1} AS (
  SELECT tree, r, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d,
         (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}_runs{k})""" for k in range(levels))


def _climbs(name: str, levels: int) -> str:
    """CTEs that carry <name>_at0 (tree, r, proof, node, ...) up the runs of <name>: proofs grow, nodes are folded."""
    left, right = f"s.ds[1:p.r % {FANOUT}]", f"s.ds[p.r % {FANOUT} + 2:]"
    return ",".join(f"""
{name}_at{k + 1} AS (
  SELECT p.* EXCLUDE (r, proof, node), p.r // {FANOUT} AS r,
         CASE WHEN s.n > 1 THEN p.proof || array_to_string(list_concat({left}, {right}), '') ELSE p.proof END AS proof,
         CASE WHEN s.n > 1 THEN sha256(array_to_string({left}, '') || p.node || array_to_string({right}, ''))
              ELSE p.node END AS node
  FROM {name}_at{k} p JOIN {name}_runs{k} s ON s.tree = p.tree AND s.r = p.r // {FANOUT})""" for k in range(levels))


# Levels of the folds in SQL: enough for FANOUT ** LEVELS leaves of a language and FANOUT ** TOP_LEVELS languages.
LEVELS, TOP_LEVELS = 8, 3


def merkle_sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 bit by bit, reflected polynomial 0xEDB88320
    bits = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, b: {bits}), 4294967295)"
    return f"""
WITH given AS (
  SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM documents),
hashed AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
         {leaf(f"(CASE WHEN {crc} % 3 = 0 THEN {lowered} ELSE text END)")} AS seen
  FROM given),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hashed),
low0 AS (SELECT tree, r, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_folds("low", LEVELS)},
top0 AS (SELECT 0 AS tree, tree AS r, d, count(*) OVER () AS n FROM low{LEVELS}),
{_folds("top", TOP_LEVELS)},
low_at0 AS (SELECT doc_id, leaf, tree, r, '' AS proof, seen AS node FROM leaves),
{_climbs("low", LEVELS)},
top_at0 AS (
  SELECT a.doc_id, a.leaf, l.d AS subroot, 0 AS tree, a.tree AS r, a.proof, a.node
  FROM low_at{LEVELS} a JOIN low{LEVELS} l USING (tree)),
{_climbs("top", TOP_LEVELS)}
SELECT a.doc_id, a.leaf, a.subroot, t.d AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root,
       a.node = t.d AS verified
FROM top_at{TOP_LEVELS} a, top{TOP_LEVELS} t"""
