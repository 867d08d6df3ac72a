"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from . import quality_rules as qr
from . import secrets as sec

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality_sql() -> str:
    levels = range(min(map(len, qr.GRID.values())))
    any_of = lambda i: " OR ".join(f"{r} > {c[i]!r}" for r, c in qr.GRID.items())
    counts = " UNION ALL ".join(f"SELECT stratum, {i} AS level, count(*) AS n, count(*) FILTER (WHERE {any_of(i)}) AS k FROM good GROUP BY stratum" for i in levels)
    above = " OR ".join(f"(c.level = {i} AND ({any_of(i)}))" for i in levels)
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
base AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS bang
    FROM d LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio, CASE WHEN word_chars > 0 THEN bang / word_chars ELSE 0 END AS exclaim_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars FROM base),
good AS (SELECT m.* FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({counts}),
tails AS (SELECT stratum, level, CASE WHEN k >= n * {qr.RISK!r} THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(qr.RISK)!r} + (n - i) * {math.log1p(-qr.RISK)!r}))) END
    <= {qr.DELTA!r} / (SELECT count(DISTINCT stratum) FROM good) AS passed FROM tests),
certified AS (SELECT stratum, min(level) AS level FROM tails t WHERE NOT EXISTS (SELECT 1 FROM tails u WHERE u.stratum = t.stratum AND u.level >= t.level AND NOT u.passed) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({above}, false) AS kept FROM m LEFT JOIN certified c USING (stratum)"""


def _spans_sql(rule: sec.Rule, place: int) -> str:
    p = rule.pattern.replace("'", "''")
    return rf"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind,
    (coalesce(list_sum(list_transform(g[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n, length(k[i]) AS kn
    FROM (SELECT doc_id, m, g, k, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_split_to_array(text, '{p}') AS g,
    regexp_extract_all(text, '{p}', {rule.group}) AS k FROM d WHERE regexp_matches(text, '{p}'))) WHERE length(k[i]) >= {rule.least}"""


def _secrets_sql() -> str:
    spans = " UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(sec.RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE place = {i}) AS n_{r.kind}" for i, r in enumerate(sec.BASE))
    n = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in sec.BASE)
    one = "kind || ':' || s || ':' || (s + n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({spans}),
a AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY s, place) FILTER (WHERE place < {len(sec.BASE)}) AS base, string_agg({one}, ',' ORDER BY s, place) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {n}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


SQL = {"op6_secret_scans": _secrets_sql(), "op9_quality_rules": _quality_sql()}
