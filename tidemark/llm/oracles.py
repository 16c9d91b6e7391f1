"""What operators return in DuckDB's SQL, for those that it can express."""

from __future__ import annotations

from . import licenses
from .quality_rules import APART, LINES_PERCENT, MIN_WORDS, POINTS, REJECT_RATE, SURE, SYMBOLS_PERCENT, WORD_LENGTHS

_WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT unnest([1, 2, 4]) AS f),
pts AS (SELECT doc_id, CAST(greatest(count(*) FILTER (100 * n_symbols > {SYMBOLS_PERCENT} * f * n_words), count(*) FILTER (100 * n_dup_lines > {LINES_PERCENT} * f * n_lines),
  count(*) FILTER (f * word_chars < {WORD_LENGTHS[0]} * n_words OR word_chars > {WORD_LENGTHS[1]} * f * n_words)) AS INTEGER) AS soft_points FROM m, f GROUP BY doc_id),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m JOIN pts USING (doc_id)),
h AS (SELECT host, count(*) AS n, CAST(count(*) FILTER (base_failed OR soft_points > 0) AS DOUBLE) AS f FROM r GROUP BY host),
s AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1.0 / n) AS inv, avg(n) AS size FROM h),
p AS (SELECT m, greatest(2.0, CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE size END) AS strength FROM s),
q AS (SELECT host, n, m, strength, (f + m * strength) / (n + strength) AS rate, {APART} * sqrt(m * (1 - m) / (strength + 1)) AS spread FROM h, p),
u AS (SELECT *, CAST({SURE} AS DOUBLE) * sqrt(rate * (1 - rate) / (n + strength + 1)) AS unsure FROM q),
j AS (SELECT r.*, rate, CASE WHEN rate - unsure > {REJECT_RATE} THEN 'rejected' WHEN rate - unsure > m + spread THEN 'suspect' WHEN rate + unsure < m - spread THEN 'trusted' ELSE 'ordinary' END AS host_verdict FROM r JOIN u USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_verdict <> 'rejected' AND soft_points < CASE host_verdict WHEN 'suspect' THEN {POINTS["suspect"]} WHEN 'trusted' THEN {POINTS["trusted"]} ELSE {POINTS["ordinary"]} END AS kept,
  soft_points, host_verdict, round(rate, 6) AS host_rate FROM j"""


def _templates() -> str:
    rows = [(n, b) for n, t in sorted(licenses.TEMPLATES.items()) for b in sorted(licenses.bigrams(licenses.normal(t)))]
    return ", ".join(f"('{n}', '{b}')" for n, b in rows)


LICENSE_SCAN = f"""
WITH tpl(name, b) AS (VALUES {_templates()}), sizes AS (SELECT name, count(*) AS m FROM tpl GROUP BY name),
units AS (SELECT doc_id, -1 AS unit, coalesce(text, '') AS t FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, unnest(range(0, len(l))) AS unit, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, unit, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM units),
b AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS b FROM (SELECT doc_id, unit, w, unnest(range(1, len(w))) AS i FROM w)),
n AS (SELECT doc_id, unit, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT doc_id, unit, name, count(*) AS c FROM b JOIN tpl USING (b) GROUP BY ALL),
dice AS (SELECT doc_id, unit, name, 2.0 * c / (n + m) AS dice FROM c JOIN n USING (doc_id, unit) JOIN sizes USING (name)),
hits AS (SELECT doc_id, unit, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM dice WHERE dice >= {licenses.LEAST_DICE} GROUP BY ALL)
SELECT d.doc_id, count(unit) AS n_units, round(coalesce(max(dice), 0.0), 6) AS best_dice, coalesce(string_agg(unit || ':' || name, ',' ORDER BY unit), '') AS matches
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""
