"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import license_scan, quality_rules

_P = quality_rules.Params()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ratio(rule: str) -> str:
    top, bottom = quality_rules.RULES[rule]
    under = "(n_words * 20)" if bottom == "n_words_x20" else bottom
    return f"CASE WHEN {under} > 0 THEN {top} / {under} ELSE 0.0 END"


_RATIOS = " UNION ALL ".join(f"SELECT *, '{r}' AS rule, {_ratio(r)} AS ratio FROM measured" for r in quality_rules.RULES)
_CUTOFFS = ", ".join(f"({c!r}::DOUBLE)" for c in _P.candidates)
_SHARE = _P.alpha / len(quality_rules.RULES)

OP1 = f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM texts WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, t.lang, len(t.ws) AS n_words, length(array_to_string(t.ws, '')) AS word_chars, length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, len(t.ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(t.ws) AS base_failed
  FROM texts t LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
ratios AS ({_RATIOS}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING avg(quality) >= 0.5),
trials AS (SELECT r.doc_id, min(r.lang) AS lang, r.rule, max(r.ratio) AS ratio FROM ratios r SEMI JOIN good g ON g.doc_id = r.doc_id WHERE NOT r.base_failed GROUP BY r.doc_id, r.rule),
counted AS (SELECT r.lang, r.rule, c.cutoff, count(*) AS n, count(*) FILTER (WHERE r.ratio >= c.cutoff) AS k FROM trials r CROSS JOIN (VALUES {_CUTOFFS}) c(cutoff) GROUP BY r.lang, r.rule, c.cutoff),
tests AS (SELECT lang AS stratum, rule, cutoff, n, k FROM counted WHERE lang IS NOT NULL AND n >= {_P.min_stratum} UNION ALL SELECT '*', rule, cutoff, sum(n)::BIGINT, sum(k)::BIGINT FROM counted GROUP BY rule, cutoff),
tails AS (SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})))) END AS p, count(*) OVER () AS hypotheses FROM tests),
cutoffs AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE p <= {_P.delta!r} / hypotheses GROUP BY stratum, rule),
strata AS (SELECT DISTINCT stratum FROM tails WHERE stratum = '*' OR pow(1 - {_SHARE!r}, n) <= {_P.delta!r} / hypotheses),
rejected AS (SELECT DISTINCT r.doc_id FROM ratios r LEFT JOIN strata s ON s.stratum = r.lang JOIN cutoffs c ON c.rule = r.rule AND c.stratum = coalesce(s.stratum, '*') WHERE r.ratio >= c.cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept FROM measured m LEFT JOIN rejected x ON x.doc_id = m.doc_id
"""

_KNOWN = "CASE " + " ".join(f"WHEN s = '{text}' THEN '{name}'" for text, name in license_scan._KNOWN.items()) + " END"
_NAMES = list(dict.fromkeys(name for name, _ in license_scan.RULES))


def _fits(name: str) -> str:
    return " OR ".join("regexp_matches(line, '," + ",(?:[A-Z0-9_]+,)*".join(ids) + ",')" for n, ids in license_scan.RULES if n == name)


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' +', ' ', 'g'))"
_PLAIN = "regexp_replace(trim(regexp_replace(r, '\\|+', ' ', 'g')), '^neither the name of .*? nor ', 'neither the name of the copyright holder nor ')"

# A piece ends where . ! ? ; : is followed by white space; the mark chr(1) stands there.
OP3 = f"""
WITH pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '([.!?;:])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(lower(x), '{license_scan._HINT}')) AS p FROM documents),
runs AS (SELECT doc_id, flatten(list_transform(p, lambda y: regexp_extract_all('|' || array_to_string(list_transform(string_split(y, chr(10)), lambda x: {_NORMAL}), '||') || '|', '{license_scan.RUN}'))) AS r_ FROM pieces),
found AS (SELECT doc_id, list_filter(list_transform(list_transform(r_, lambda r: {_PLAIN}), lambda s: {_KNOWN}), lambda x: x IS NOT NULL) AS ids FROM runs),
lines AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS line FROM found),
hits AS (SELECT doc_id, ids, list_filter([{", ".join(f"CASE WHEN {_fits(n)} THEN '{n}' END" for n in _NAMES)}], lambda x: x IS NOT NULL) AS names FROM lines)
SELECT doc_id, len(ids)::BIGINT AS n_license_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses, names[1] AS license FROM hits
"""

OP4 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM texts WHERE len(ws) >= 4) UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM texts WHERE len(ws) BETWEEN 1 AND 3)),
sizes AS (SELECT t.doc_id, count(s.s) AS n FROM texts t LEFT JOIN shingles s USING (doc_id) GROUP BY t.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""
