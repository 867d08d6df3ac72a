"""DuckDB SQL for the queries of ``queries.py``, written independently of the column expressions."""

from __future__ import annotations

from .functions.text import COUNTRIES, LEGAL_FORMS, MISSING, STREET_WORDS
from .operators.blocking import STOPWORDS
from .operators.evaluate import THRESHOLDS
from .operators.profile import MATCH_GROUPS
from .operators.rules import ADDRESS_BRACKETS, NAME_BRACKETS, RULES
from .queries import COUNTRY_SPELLINGS, ODD_TEXTS, SUFFIXES

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PUNCT = r"[\p{Pc}\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}\p{S}]"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


_MISSING = "(" + ", ".join(_text(v) for v in MISSING) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _valid(x: str) -> str:
    return f"({x} IS NOT NULL AND lower({_strip(x)}) NOT IN {_MISSING})"


def _swap(x: str, word: str, to: str) -> str:
    import re

    # No lookaround here: the neighbours are captured and put back (twice, for neighbours that two words share).
    one = rf"regexp_replace({x}, '(^|[^a-z0-9_]){re.escape(word)}($|[^a-z0-9_])', '\1{to}\2', 'g')"
    return rf"regexp_replace({one}, '(^|[^a-z0-9_]){re.escape(word)}($|[^a-z0-9_])', '\1{to}\2', 'g')"


def _steps(name: str, source: str, column: str, swaps: list[tuple[str, str]], before: bool) -> str:
    """CTEs that normalise one ASCII column, a word at a time (``before``: words first, then punctuation)."""
    clean = rf"regexp_replace(%s, '[^a-z0-9 -]', ' ', 'g')"
    trim = "trim(regexp_replace(%s, ' +', ' ', 'g'))"
    start = trim % f"lower({column})"
    out = [f"{name}0 AS (SELECT *, {start if before else clean % start} AS {name}_v FROM {source})"]
    for i, (word, to) in enumerate(swaps, 1):
        out.append(f"{name}{i} AS (SELECT * REPLACE ({_swap(f'{name}_v', word, to)} AS {name}_v) FROM {name}{i - 1})")
    last = f"{name}{len(swaps)}"
    final = trim % (clean % f"{name}_v" if before else f"{name}_v")
    out.append(f"{name}_done AS (SELECT * EXCLUDE ({name}_v), CASE WHEN {final} IN {_MISSING} THEN NULL ELSE {final} END AS {name} FROM {last})")
    return ",\n".join(out)


_forms = [(v, token) for token, variants in LEGAL_FORMS.items() for v in variants]
_streets = list(STREET_WORDS.items())
_country = "CASE " + " ".join(f"WHEN lower(country) = {_text(k)} THEN {_text(v)}" for k, v in COUNTRIES.items()) + " ELSE upper(country) END"
_RAW = f"""raw AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id,
    CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || {_list(SUFFIXES)}[p_size % 8 + 1] AS business_name,
    CASE WHEN p_partkey % 30 <> 0 THEN p_size || ' ' || p_type || ' St' END AS business_address,
    {_list(COUNTRY_SPELLINGS)}[p_partkey % 5 + 1] AS country, 'S' || (p_partkey % 3 + 1) AS src, p_name, p_brand, p_partkey AS key FROM part)"""
_NORM = f"""{_RAW},
{_steps("name_norm", "raw", "business_name", _forms, True)},
{_steps("addr_norm", "name_norm_done", "business_address", _streets, False)},
er AS MATERIALIZED (SELECT *, {_country} AS country_norm FROM addr_norm_done),
s1 AS (SELECT * FROM er WHERE src = 'S1'), sec AS (SELECT * FROM er WHERE src <> 'S1'),
gt AS (SELECT a.entity_id AS s1_id, b.src AS source, b.entity_id AS secondary_id FROM s1 a JOIN sec b USING (p_name, p_brand, country_norm)),
toks AS (SELECT entity_id, src, country_norm, unnest(list_distinct(list_filter(string_split(name_norm, ' '), lambda t: length(t) >= 3 AND NOT list_contains({_list(STOPWORDS)}, t)))) AS t FROM er),
pre AS (SELECT entity_id, src, country_norm, substr(name_norm, 1, 5) AS t FROM er WHERE length(name_norm) >= 2),
tiers AS (SELECT s1_id, secondary_id, min(tier) AS tier FROM (
    SELECT a.entity_id AS s1_id, b.entity_id AS secondary_id, 1 AS tier FROM s1 a JOIN sec b USING (country_norm, name_norm)
    UNION ALL SELECT a.entity_id, b.entity_id, 2 FROM pre a JOIN pre b USING (country_norm, t) WHERE a.src = 'S1' AND b.src <> 'S1'
    UNION ALL SELECT a.entity_id, b.entity_id, 2 FROM toks a JOIN toks b USING (country_norm, t) WHERE a.src = 'S1' AND b.src <> 'S1') GROUP BY ALL),
per AS (SELECT s.entity_id AS s1_id, count(g.source) AS n, count(g.source) FILTER (WHERE g.source = 'S2') AS n2, count(g.source) FILTER (WHERE g.source = 'S3') AS n3
    FROM s1 s LEFT JOIN gt g ON g.s1_id = s.entity_id GROUP BY 1)"""
_ranked = "SELECT entity_id AS s1_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS r, count(*) OVER () AS n FROM s1"
_SPLIT = f"""splits AS (SELECT s1_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'holdout' END AS split FROM ({_ranked})),
sp AS (SELECT t.s1_id, t.secondary_id, substr(t.secondary_id, 1, 2) AS source, (g.s1_id IS NOT NULL)::INT AS label, s.split
    FROM tiers t JOIN splits s USING (s1_id) LEFT JOIN gt g ON g.s1_id = t.s1_id AND g.secondary_id = t.secondary_id WHERE t.tier = 1)"""


def _er(body: str) -> str:
    return f"WITH {_NORM}\n{body}"


def _raw(body: str) -> str:
    return f"WITH {_RAW}\n{body}"


def _sp(body: str) -> str:
    return f"WITH {_NORM},\n{_SPLIT}\n{body}"


_ODD = f"odd AS (SELECT entity_id, CASE WHEN key % 13 <> 12 THEN {_list(ODD_TEXTS)}[key % 13 % 12 + 1] END AS v FROM raw)"
_BAD = "bad AS (SELECT * REPLACE (CASE WHEN key % 17 = 0 THEN 'X9-' || key WHEN key % 17 = 1 THEN '' ELSE entity_id END AS entity_id) FROM raw)"
_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
_BI = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) WHEN length({0}) = 1 THEN [{0}] ELSE [] END"


def _jac(a: str, b: str, empty: str = "1.0") -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN {empty} ELSE {common} / (len({a}) + len({b}) - {common}) END"


def _jw(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE jaro_winkler_similarity({a}, {b}) END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE least(length({a}), length({b})) / greatest(length({a}), length({b})) END"


def _tokens(a: str, b: str, empty: str = "1.0") -> str:
    return _jac(_TOK.format(a), _TOK.format(b), empty)


def _composite(a: str, b: str) -> str:
    return f"(0.4::DOUBLE * ({_jw(a, b)}) + 0.3::DOUBLE * ({_lev(a, b)}) + 0.3::DOUBLE * ({_tokens(a, b)}))"


def _scored(expression: str) -> str:
    return _er(f"""SELECT a, b, round_even(({expression})::DOUBLE, 6) AS score FROM (SELECT DISTINCT x.name_norm AS a, y.name_norm AS b FROM s1 x JOIN sec y USING (p_brand) WHERE y.src = 'S2')""")


def _features() -> str:
    e = []
    for p, a, b in (("name", "an", "bn"), ("addr", "aa", "ba")):
        parts = {
            "exact_norm": (f"({a} = {b} AND {a} <> '')::INT", "0"), "jaro_winkler": (_jw(a, b), "0.0"), "levenshtein_norm": (_lev(a, b), "0.0"), "token_similarity": (_tokens(a, b), "0.0"),
            "len_diff": (f"abs(length({a}) - length({b}))::INT", "0"), "len_ratio": (_ratio(a, b), "0.0"), "token_count_diff": (f"abs(len({_TOK.format(a)}) - len({_TOK.format(b)}))::INT", "0"), "sim_composite": (_composite(a, b), "0.0"),
        }
        for k, (x, zero) in parts.items():
            e.append(f"{x} AS {p}_{k}" if p == "name" else f"CASE WHEN both_present THEN {x} ELSE {zero} END AS {p}_{k}")
    e.append(f"{_jac(_BI.format('an'), _BI.format('bn'))} AS name_char_bigram_sim")
    doubles = ["name_jaro_winkler", "name_levenshtein_norm", "name_token_similarity", "name_len_ratio", "name_char_bigram_sim", "addr_jaro_winkler", "addr_levenshtein_norm", "addr_token_similarity", "addr_len_ratio", "name_sim_composite", "addr_sim_composite"]
    ints = ["name_exact_norm", "name_len_diff", "name_token_count_diff", "addr_exact_norm", "addr_len_diff", "addr_token_count_diff"]
    rounded = ", ".join(f"round_even({c}::DOUBLE, 6) AS {c}" for c in doubles)
    return _er(f"""SELECT s1_id, secondary_id, same AS country_equal, same AS same_country, raw_equal AS name_exact_raw, {", ".join(ints)}, {rounded},
    (NOT both_present)::INT AS addr_missing, both_present::INT AS addr_both_present,
    round_even(combined::DOUBLE, 6) AS combined_weighted_sim, round_even((CASE WHEN both_present THEN combined ELSE name_sim_composite END)::DOUBLE, 6) AS combined_name_dominant_sim,
    round_even((name_exact_norm * addr_jaro_winkler)::DOUBLE, 6) AS interaction_name_x_addr, (same = 1 AND name_jaro_winkler >= 0.9)::INT AS country_strong_name
    FROM (SELECT *, CASE WHEN both_present THEN 0.6::DOUBLE * name_sim_composite + 0.4::DOUBLE * addr_sim_composite ELSE name_sim_composite END AS combined FROM (
      SELECT *, {", ".join(e)} FROM (SELECT t.s1_id, t.secondary_id, a.business_address IS NOT NULL AND b.business_address IS NOT NULL AS both_present,
        coalesce(a.name_norm, '') AS an, coalesce(b.name_norm, '') AS bn, coalesce(a.addr_norm, '') AS aa, coalesce(b.addr_norm, '') AS ba,
        (a.country_norm = b.country_norm)::INT AS same, (a.business_name = b.business_name)::INT AS raw_equal
        FROM tiers t JOIN s1 a ON a.entity_id = t.s1_id JOIN sec b ON b.entity_id = t.secondary_id WHERE t.tier = 1)))""")


def _metrics(source: str, extra: str) -> str:
    return f"""SELECT {extra}, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp, fp, fn FROM {source}"""


def _rules(which: tuple[str, ...]) -> str:
    raw = "s1 a JOIN sec b ON a.business_name = b.business_name AND a.country = b.country"
    norm = "s1 a JOIN sec b ON coalesce(a.name_norm, '') = coalesce(b.name_norm, '') AND coalesce(a.country_norm, '') = coalesce(b.country_norm, '')"
    near = _jw("coalesce(a.addr_norm, '')", "coalesce(b.addr_norm, '')") + " >= 0.6"
    joins = {RULES[0]: raw, RULES[1]: norm, RULES[2]: f"{norm} WHERE {near}", RULES[3]: f"{norm} WHERE ({near}) OR b.business_address IS NULL"}
    hits = " UNION ALL ".join(f"SELECT '{r}' AS rule, a.entity_id AS s1_id, b.entity_id AS secondary_id, b.src AS source FROM {joins[r]}" for r in which)
    rules = _list(which)
    return _er(f""", hits AS ({hits}),
    by_source AS (SELECT rule, h.source, count(g.s1_id) AS tp, count(*) - count(g.s1_id) AS fp FROM hits h LEFT JOIN gt g ON g.s1_id = h.s1_id AND g.secondary_id = h.secondary_id GROUP BY ALL),
    grid AS (SELECT r.rule, s.source, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, (SELECT count(*) FROM gt WHERE gt.source = s.source) AS n_true FROM (SELECT unnest({rules}) AS rule) r, (SELECT unnest(['S2', 'S3']) AS source) s LEFT JOIN by_source b ON b.rule = r.rule AND b.source = s.source),
    total AS (SELECT rule, coalesce(source, 'Overall') AS source, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, (sum(n_true) - sum(tp))::BIGINT AS fn FROM grid GROUP BY GROUPING SETS ((rule, source), (rule)))
    SELECT rule, source, tp, fp, fn, round_even(p::DOUBLE, 6) AS precision, round_even(r::DOUBLE, 6) AS recall, round_even((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)::DOUBLE, 6) AS f1 FROM ({_metrics("total", "rule, source")})""")


_SAMPLE = (
    """, picked AS (SELECT s1_id, source, secondary_id FROM gt ORDER BY md5('42:' || s1_id || ':' || secondary_id), s1_id, secondary_id LIMIT {k}),
sims AS (SELECT *, CASE WHEN an = '' AND bn = '' THEN 1.0 ELSE ({jwn}) END AS jn, 1 - levenshtein(an, bn) / greatest(length(an), length(bn), 1) AS ln, {tn} AS tn,
    CASE WHEN missing THEN 0.0 WHEN aa = '' AND ba = '' THEN 1.0 ELSE ({jwa}) END AS ja, CASE WHEN missing THEN 0.0 ELSE 1 - levenshtein(aa, ba) / greatest(length(aa), length(ba), 1) END AS la, CASE WHEN missing THEN 0.0 ELSE {ta} END AS ta
    FROM (SELECT p.*, a.business_name AS ar, b.business_name AS br, coalesce(a.name_norm, '') AS an, coalesce(b.name_norm, '') AS bn, coalesce(a.addr_norm, '') AS aa, coalesce(b.addr_norm, '') AS ba,
      a.country_norm = b.country_norm AS same_country, b.business_address IS NULL AS missing FROM picked p JOIN s1 a ON a.entity_id = p.s1_id JOIN sec b ON b.entity_id = p.secondary_id)),
sample AS (SELECT s1_id, secondary_id, source, ar = br AS exact_raw, an = bn AS exact_norm, ar <> br AND (an = bn OR jn >= 0.85) AS similar_format, same_country, missing AS addr_missing, ja >= 0.7 AS addr_similar,
    round_even(jn::DOUBLE, 4) AS name_jw, round_even(ln::DOUBLE, 4) AS name_lev, round_even(tn::DOUBLE, 4) AS name_tok, round_even(ja::DOUBLE, 4) AS addr_jw, round_even(la::DOUBLE, 4) AS addr_lev, round_even(ta::DOUBLE, 4) AS addr_tok,
    round_even((CASE WHEN missing THEN jn ELSE 0.6::DOUBLE * jn + 0.4::DOUBLE * ja END)::DOUBLE, 4) AS combined FROM sims)"""
    .replace("{k}", "5000").replace("{jwn}", _jw("an", "bn")).replace("{jwa}", _jw("aa", "ba")).replace("{tn}", _tokens("an", "bn", "0.0")).replace("{ta}", _tokens("aa", "ba", "0.0"))
)


def _sample(body: str) -> str:
    return f"WITH {_NORM}{_SAMPLE}\n{body}"


def _brackets() -> str:
    rows = []
    for field, table in (("name_jw", NAME_BRACKETS), ("addr_jw", ADDRESS_BRACKETS)):
        for label, low, high in table:
            test = " AND ".join(x for x in (f"{field} >= {low!r}" if low is not None else "", f"{field} < {high!r}" if high is not None else "") if x)
            rows.append((field, label, test))
    rows.append(("addr_jw", "missing", "addr_missing"))
    return _sample(" UNION ALL ".join(f"SELECT '{f}' AS field, '{b}' AS bracket, count(*) FILTER (WHERE {t}) AS n, round_even(100 * count(*) FILTER (WHERE {t}) / count(*), 2) AS pct FROM sample" for f, b, t in rows))


_SCORES = "sc AS (SELECT quality AS label, least(1.0, n_chars / 4000) AS score FROM labels JOIN documents USING (doc_id))"


def _metric_row(beta: float) -> str:
    b2 = beta * beta
    f = lambda b: f"CASE WHEN {b} * p + r > 0 THEN (1 + {b}) * p * r / ({b} * p + r) ELSE 0 END"
    cols = ", ".join(f"round_even(({x})::DOUBLE, 6) AS {n}" for n, x in (("precision", "p"), ("recall", "r"), ("f1", f(1.0)), ("f_beta", f(b2))))
    return f"SELECT threshold, {cols}, tp, fp, fn, tn, tp + fp AS n_predicted_positive, tp + fn AS n_actual_positive, tp + fp + fn + tn AS support"


def _sweep(thresholds, beta: float) -> str:
    return f"""WITH {_SCORES}, c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, count(*) AS n FROM sc, (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in thresholds)}]) AS threshold) GROUP BY threshold)
{_metric_row(beta)} FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT threshold, tp, fp, fn, n - tp - fp - fn AS tn FROM c))"""


def _block(table: str) -> str:
    return _er(f"""SELECT entity_id, count(*) AS n, min(c) AS first, max(c) AS last FROM (SELECT DISTINCT a.entity_id, b.entity_id AS c FROM {table} a JOIN {table} b USING (t) WHERE a.src = 'S1' AND b.src <> 'S1') GROUP BY 1""")


def _lengths(source: str, *fields: str) -> str:
    q = lambda p: f"quantile_disc(length({{f}}), {p})::BIGINT"
    one = f"""SELECT '{{f}}' AS field, count(*) AS n, min(length({{f}}))::BIGINT AS min, max(length({{f}}))::BIGINT AS max, round_even(avg(length({{f}})), 4) AS mean, {q(0.5)} AS p50, {q(0.9)} AS p90, {q(0.95)} AS p95, {q(0.99)} AS p99,
    count(*) FILTER (WHERE regexp_matches({{f}}, '[^\\x00-\\x7F]')) AS non_ascii FROM {source} WHERE coalesce({{f}}, '') <> ''"""
    return " UNION ALL ".join(one.replace("{f}", f) for f in fields)


def _missing(source: str, *fields: str) -> str:
    c = "coalesce({f}, '')"
    one = f"""SELECT '{{f}}' AS field, count(*) AS total, count(*) FILTER (WHERE {c} = '') AS missing, count(*) FILTER (WHERE {c} <> '' AND trim({c}) = '') AS blank,
    count(*) FILTER (WHERE trim({c}) <> '') AS valid, round_even(100 * count(*) FILTER (WHERE trim({c}) = '') / count(*), 2) AS missing_pct FROM {source}"""
    return " UNION ALL ".join(one.replace("{f}", f) for f in fields)


_groups = " UNION ALL ".join(
    f"SELECT {_text(label)} AS label, count(*) FILTER (WHERE n >= {lo}{'' if hi is None else f' AND n <= {hi}'}) AS n, round_even(100 * count(*) FILTER (WHERE n >= {lo}{'' if hi is None else f' AND n <= {hi}'}) / count(*), 2) AS pct FROM per" for label, lo, hi in MATCH_GROUPS
)
_wanted = "want AS (SELECT s1_id, CASE WHEN n2 = 0 THEN 1 ELSE greatest(1, round_even(n2 * 2.0, 0)) END AS target FROM per)"
_free = "SELECT s.entity_id AS s1_id, b.entity_id AS secondary_id, b.src FROM s1 s JOIN sec b USING (country_norm) WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.s1_id = s.entity_id AND g.secondary_id = b.entity_id)"


def _per_source(source: str, n: str) -> str:
    """Negatives of each record of one source: no more than its country has left."""
    return f"""SELECT p.s1_id, least(CASE WHEN p.{n} = 0 THEN 1 ELSE greatest(1, round_even(p.{n} * 2.0, 0)) END, count(f.secondary_id))::BIGINT AS n FROM per p LEFT JOIN free f ON f.s1_id = p.s1_id AND f.src = '{source}' GROUP BY p.s1_id, p.{n}"""


def _exact_negatives(source: str, n: str) -> str:
    return f"""SELECT least(CASE WHEN p.{n} = 0 THEN 1 ELSE greatest(1, round_even(p.{n} * 2.0, 0)) END, count(t.secondary_id))::BIGINT AS n FROM per p LEFT JOIN (SELECT * FROM tiers t WHERE tier = 1 AND NOT EXISTS (SELECT 1 FROM gt g WHERE g.s1_id = t.s1_id AND g.secondary_id = t.secondary_id)) t
    ON t.s1_id = p.s1_id AND t.secondary_id LIKE '{source}-%' GROUP BY p.s1_id, p.{n}"""


_valid_v = _valid("v")
SQL: dict[str, str] = {
    "scan_delimited": _raw("SELECT entity_id, business_name, business_address, country FROM raw WHERE key % 7 <> 0"),
    "scan_pruned": _raw("SELECT entity_id, country FROM raw WHERE key % 7 <> 0"),
    "scan_malformed": _raw("SELECT count(*) AS lines, count(*) FILTER (WHERE key % 7 = 0) AS malformed FROM raw"),
    "gt_matched_ids": _er("SELECT source, count(*) AS matches, count(DISTINCT secondary_id) AS distinct_ids FROM gt GROUP BY source"),
    "pilot_distinct": _er("SELECT count(DISTINCT entity_id) AS ids, count(DISTINCT name_norm) AS names, count(DISTINCT CASE WHEN length(name_norm) >= 5 THEN substr(name_norm, 1, 5) END) AS prefixes, count(DISTINCT country_norm) AS countries FROM s1"),
    "scan_head": _raw("SELECT entity_id, business_name, business_address, country FROM raw ORDER BY entity_id LIMIT 50"),
    "stream_candidates": _er("SELECT a.entity_id AS s1_id, b.entity_id AS secondary_id FROM s1 a JOIN sec b USING (country_norm, name_norm)"),
    "scan_ground_truth": _er("SELECT s1_id, source, secondary_id FROM gt"),
    "write_shards": _sp("SELECT split, shard, count(*) AS rows FROM (SELECT split, floor((row_number() OVER (PARTITION BY split) - 1) / 100)::INT AS shard FROM sp) GROUP BY ALL"),
    "normalize_name": _er("SELECT entity_id, name_norm FROM er"),
    "normalize_address": _er("SELECT entity_id, addr_norm FROM er"),
    "normalize_country": _er("SELECT entity_id, country_norm FROM er"),
    "normalize_punctuation": rf"SELECT page_id, regexp_replace(regexp_replace(url, '\p{{Pd}}', '-', 'g'), '{_PUNCT}', ' ', 'g') AS clean, regexp_replace(regexp_replace(url, '\p{{Pd}}', ' ', 'g'), '{_PUNCT}', ' ', 'g') AS no_hyphens FROM pages",
    "normalize_whitespace": rf"SELECT doc_id, CASE WHEN {_valid('text')} THEN md5(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))) END AS digest FROM documents",
    "unicode_normalize": f"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') AND NOT {_valid('text')} THEN NULL ELSE nfc_normalize(text) END) AS digest FROM documents",
    "to_lowercase": f"SELECT doc_id, CASE WHEN {_valid('text')} THEN md5(lower(text)) END AS digest FROM documents",
    "is_missing_filter": f"WITH {_RAW}, {_ODD} SELECT entity_id, v FROM odd WHERE NOT {_valid_v}",
    "safe_field": f"WITH {_RAW}, {_ODD} SELECT entity_id, CASE WHEN {_valid_v} THEN {_strip('v')} ELSE '' END AS v FROM odd",
    "validate_records": f"WITH {_RAW}, {_BAD} SELECT key, CASE WHEN entity_id <> '' AND NOT regexp_matches(entity_id, '^S[123]-') THEN 'unknown id prefix: ' || entity_id ELSE '' END AS errors FROM bad",
    "validate_dataframe": f"""WITH {_RAW}, {_BAD} SELECT count(*) AS n_rows, count(*) FILTER (WHERE entity_id IS NULL) AS null_entity_id, count(*) FILTER (WHERE business_name IS NULL) AS null_business_name,
    count(*) FILTER (WHERE business_address IS NULL) AS null_business_address, count(*) FILTER (WHERE country IS NULL) AS null_country, count(*) FILTER (WHERE entity_id LIKE 'X9%') AS unknown_prefix FROM bad""",
    "country_block_volume": _er("SELECT country_norm, n_left, n_right, n_left * n_right AS n_pairs FROM (SELECT country_norm, count(*) AS n_left FROM s1 GROUP BY 1) JOIN (SELECT country_norm, count(*) AS n_right FROM sec GROUP BY 1) USING (country_norm)"),
    "exact_name_block": _er("SELECT a.entity_id, b.entity_id AS candidate_id FROM s1 a JOIN sec b USING (name_norm)"),
    "prefix_block": _block("pre"),
    "token_block": _block("toks"),
    "candidate_pairs_self": _er("SELECT a.entity_id AS id_a, b.entity_id AS id_b FROM s1 a JOIN s1 b USING (name_norm, country_norm) WHERE a.entity_id < b.entity_id"),
    "candidate_pairs_all_strategies": _er("""SELECT id_a, count(*) AS n, min(id_b) AS first FROM (SELECT a.entity_id AS id_a, b.entity_id AS id_b FROM s1 a JOIN s1 b USING (name_norm, country_norm) WHERE a.entity_id < b.entity_id
    UNION SELECT a.entity_id, b.entity_id FROM pre a JOIN pre b USING (t, country_norm) WHERE a.src = 'S1' AND b.src = 'S1' AND a.entity_id < b.entity_id
    UNION SELECT a.entity_id, b.entity_id FROM toks a JOIN toks b USING (t, country_norm) WHERE a.src = 'S1' AND b.src = 'S1' AND a.entity_id < b.entity_id) GROUP BY 1"""),
    "pairs_from_index": _er("SELECT name_norm AS block_key, (count(*) * (count(*) - 1) / 2)::BIGINT AS n FROM s1 GROUP BY 1 HAVING count(*) > 1"),
    "block_reduction_ratio": _er("SELECT n, pairs, round_even(1 - least(pairs, n * (n - 1) / 2) / (n * (n - 1) / 2), 9) AS ratio FROM (SELECT sum(m)::BIGINT AS n, sum(m * (m - 1) / 2)::BIGINT AS pairs FROM (SELECT count(*) AS m FROM er WHERE name_norm IS NOT NULL GROUP BY name_norm))"),
    "bipartite_tiers": _er("SELECT s1_id, tier, count(*) AS n, min(secondary_id) AS first FROM tiers GROUP BY ALL"),
    "candidate_volumes": _er(""", v AS (SELECT 'all' AS blocking, (SELECT count(*) FROM s1) * (SELECT count(*) FROM sec) AS pairs UNION ALL SELECT 'country', (SELECT count(*) FROM s1 JOIN sec USING (country_norm))
    UNION ALL SELECT 'exact_name_country', (SELECT count(*) FROM s1 JOIN sec USING (business_name, country)) UNION ALL SELECT 'norm_name_country', (SELECT count(*) FROM s1 JOIN sec USING (name_norm, country_norm)))
    SELECT blocking, pairs, round_even(1 - pairs / (SELECT pairs FROM v WHERE blocking = 'all'), 9) AS reduction FROM v"""),
    "jaro_winkler": _scored(_jw("a", "b")),
    "levenshtein_norm": _scored(_lev("a", "b")),
    "token_jaccard": _scored(_tokens("a", "b")),
    "bigram_jaccard": _scored(_jac(_BI.format("a"), _BI.format("b"))),
    "len_ratio": _scored(_ratio("a", "b")),
    "composite_sim": _scored(_composite("a", "b")),
    "pair_features_26": _features(),
    "gt_explode": _er("SELECT s1_id, source, secondary_id FROM gt"),
    "gt_membership": _er("SELECT t.s1_id, t.secondary_id, g.s1_id IS NOT NULL AS is_match FROM tiers t LEFT JOIN gt g ON g.s1_id = t.s1_id AND g.secondary_id = t.secondary_id WHERE tier = 1"),
    "gt_counts": _er("SELECT (SELECT count(*) FROM s1) AS s1_count, count(*) FILTER (WHERE source = 'S2') AS s2_match_count, count(*) FILTER (WHERE source = 'S3') AS s3_match_count, count(*) AS total_match_count FROM gt"),
    "positives": _er("SELECT s1_id, secondary_id, source FROM gt"),
    "negatives_topk": _er(f""", {_wanted}, usable AS (SELECT t.*, row_number() OVER (PARTITION BY t.s1_id ORDER BY tier, t.secondary_id) AS r FROM tiers t LEFT JOIN gt g ON g.s1_id = t.s1_id AND g.secondary_id = t.secondary_id WHERE g.s1_id IS NULL AND t.secondary_id LIKE 'S2-%')
    SELECT s1_id, secondary_id, tier FROM usable JOIN want USING (s1_id) WHERE r <= target"""),
    "negatives_per_record": _er(f""", free AS ({_free}) SELECT s1_id, n, n AS n_distinct FROM ({_per_source("S2", "n2")}) WHERE n > 0"""),
    "class_ratio_stats": _er(f""", free AS ({_free}), neg AS (SELECT sum(n)::BIGINT AS total FROM ({_per_source("S2", "n2")} UNION ALL {_per_source("S3", "n3")})), ex AS (SELECT sum(n)::BIGINT AS exact FROM ({_exact_negatives("S2", "n2")} UNION ALL {_exact_negatives("S3", "n3")}))
    SELECT s2_positives, s3_positives, s2_positives + s3_positives AS total_positives, exact AS exact_name_negatives, total AS total_negatives, CASE WHEN s2_positives + s3_positives > 0 THEN round_even(total / (s2_positives + s3_positives), 4) ELSE 0 END AS negative_ratio
    FROM (SELECT count(*) FILTER (WHERE source = 'S2') AS s2_positives, count(*) FILTER (WHERE source = 'S3') AS s3_positives FROM gt), neg, ex"""),
    "grouped_split": _sp("SELECT s1_id, split FROM splits"),
    "hashed_split": _er("SELECT s1_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'holdout' END AS split FROM (SELECT entity_id AS s1_id, ('0x' || substr(md5('42:' || entity_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM s1)"),
    "audit_duplicates": _sp("SELECT split, s1_id, secondary_id, 2::BIGINT AS n FROM sp WHERE label = 1"),
    "audit_mislabeled": _sp("SELECT s1_id, secondary_id, split FROM sp WHERE label = 1"),
    "audit_source_mismatch": _sp("SELECT s1_id, secondary_id, 'S2' AS source FROM sp WHERE source <> 'S2'"),
    "audit_leakage": _sp("SELECT s1_id, string_agg(DISTINCT sn, ',' ORDER BY sn) AS splits FROM (SELECT s1_id, CASE WHEN source = 'S3' THEN 'holdout' ELSE split END AS sn FROM sp) GROUP BY 1 HAVING count(DISTINCT sn) > 1"),
    "label_distribution": _sp("SELECT split, label, count(*) AS n FROM sp GROUP BY ALL"),
    "shard_assignment": _sp("SELECT s1_id, secondary_id, split, floor((row_number() OVER (PARTITION BY split ORDER BY substr(md5(s1_id), 1, 2), s1_id, secondary_id) - 1) / 100)::INT AS shard FROM sp"),
    "pilot_prefilter": _er(""", few AS (SELECT * FROM s1), f AS (SELECT b.*, b.entity_id IN (SELECT g.secondary_id FROM gt g JOIN few ON few.entity_id = g.s1_id) AS is_true, b.country_norm IN (SELECT country_norm FROM few) AS in_country,
      coalesce(b.name_norm IN (SELECT name_norm FROM few), false) AS in_name, length(b.name_norm) >= 5 AND substr(b.name_norm, 1, 5) IN (SELECT substr(name_norm, 1, 5) FROM few WHERE length(name_norm) >= 5) AS in_prefix FROM sec b WHERE src = 'S2'),
    o AS (SELECT *, NOT is_true AND in_country AND NOT in_name AS is_open FROM f),
    p AS (SELECT *, is_open AND in_prefix AND row_number() OVER (PARTITION BY substr(name_norm, 1, 5), is_open AND in_prefix ORDER BY entity_id) <= 5 AS by_prefix FROM o),
    c AS (SELECT *, is_open AND NOT by_prefix AND row_number() OVER (PARTITION BY country_norm, is_open AND NOT by_prefix ORDER BY entity_id) <= 15000 AS by_country FROM p),
    k AS (SELECT entity_id, CASE WHEN is_true THEN 'match' WHEN NOT in_country THEN NULL WHEN in_name THEN 'name' WHEN by_prefix THEN 'prefix' WHEN by_country THEN 'country' END AS kept_as FROM c) SELECT * FROM k WHERE kept_as IS NOT NULL"""),
    "confusion_counts": f"WITH {_SCORES} SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM sc",
    "threshold_sweep": _sweep(THRESHOLDS, 1.0),
    "fbeta": _sweep((0.25,), 2.0),
    **{f"rule_{short}": _rules((rule,)) for short, rule in zip(("exact", "norm", "addr_strict", "addr_tolerant"), RULES)},
    "rules_rollup": _rules(RULES),
    "true_match_sample": _er("SELECT s1_id, source, secondary_id FROM gt ORDER BY md5('42:' || s1_id || ':' || secondary_id), s1_id, secondary_id LIMIT 5000"),
    "sample_features": _sample("SELECT * FROM sample"),
    "sample_rates": _sample("""SELECT count(*) AS n, """ + ", ".join(
        f"round_even(coalesce(count(*) FILTER (WHERE {t}) / nullif(count(*) FILTER (WHERE {b}), 0), 0), 9) AS {c}" for c, t, b in (
            ("exact_raw", "exact_raw", "true"), ("exact_norm", "exact_norm", "true"), ("similar_format", "similar_format", "true"), ("same_country", "same_country", "true"), ("addr_missing", "addr_missing", "true"),
            ("addr_missing_s2", "addr_missing AND source = 'S2'", "source = 'S2'"), ("addr_missing_s3", "addr_missing AND source = 'S3'", "source = 'S3'"), ("addr_similar", "addr_similar", "true"), ("addr_similar_present", "addr_similar AND NOT addr_missing", "NOT addr_missing"))
    ) + " FROM sample"),
    "dist_stats_linear": "SELECT count(*) AS count, " + ", ".join(f"round_even({x}, 4) AS {c}" for c, x in (("mean", "avg(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), *[(f"p{p}", f"quantile_cont(o_totalprice, {p / 100})") for p in (10, 25, 50, 75, 90, 95, 99)])) + " FROM orders",
    "dist_stats_floor": "SELECT n, round_even(mean, 4) AS mean, round_even(std, 4) AS std, round_even(v[1], 4) AS min, round_even(v[n], 4) AS max, " + ", ".join(f"round_even(v[least(floor(n * {p} / 100), n - 1)::INT + 1], 4) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM (SELECT count(*) AS n, avg(p_size / 8.0) AS mean, stddev_pop(p_size / 8.0) AS std, list((p_size / 8.0)::DOUBLE ORDER BY p_size) AS v FROM part)",
    "jw_brackets": _brackets(),
    "disagreement_rates": _sample("""SELECT count(*) AS n, count(*) FILTER (WHERE x) AS name_only, coalesce(round_even(100 * count(*) FILTER (WHERE x) / nullif(count(*), 0), 2), 0) AS name_only_pct, count(*) FILTER (WHERE y) AS addr_only, coalesce(round_even(100 * count(*) FILTER (WHERE y) / nullif(count(*), 0), 2), 0) AS addr_only_pct
    FROM (SELECT name_jw >= 0.92 AND NOT addr_missing AND addr_jw <> 0 AND addr_jw < 0.7 AS x, addr_jw >= 0.9 AND NOT addr_missing AND name_jw <> 0 AND name_jw < 0.8 AS y FROM sample)"""),
    "profile_missing": f"WITH {_RAW}, {_ODD}, both_ AS (SELECT v, business_address FROM odd JOIN raw USING (entity_id)) " + _missing("both_", "v", "business_address"),
    "profile_ids": f"WITH {_RAW}, {_BAD} SELECT count(*) AS total, count(DISTINCT entity_id) AS unique_ids, count(*) - count(DISTINCT entity_id) AS duplicates, count(*) FILTER (WHERE NOT regexp_matches(entity_id, '^S[123]-[0-9]+$')) AS format_mismatches FROM bad",
    "profile_lengths": f"WITH {_RAW} " + _lengths("raw", "business_name", "business_address"),
    "profile_non_ascii": _lengths("documents", "text", "lang", "source"),
    "profile_country_top10": _raw("SELECT country AS value, count(*) AS n, round_even(100 * count(*) / (SELECT count(*) FROM raw), 2) AS pct FROM raw GROUP BY 1 ORDER BY n DESC, value LIMIT 10"),
    "length_histogram": _raw("SELECT length(business_name)::INT AS value, count(*) AS n FROM raw GROUP BY 1"),
    "gt_profile": _er("SELECT count(*) AS total_s1, sum(n)::BIGINT AS total_matches, sum(n2)::BIGINT AS s2_matches, sum(n3)::BIGINT AS s3_matches, count(*) FILTER (WHERE n = 0) AS singletons, count(*) FILTER (WHERE n2 > 0 AND n3 = 0) AS s2_only, count(*) FILTER (WHERE n3 > 0 AND n2 = 0) AS s3_only, count(*) FILTER (WHERE n2 > 0 AND n3 > 0) AS both, min(n) AS min, max(n) AS max, round_even(avg(n), 4) AS mean, round_even(stddev_pop(n), 4) AS std, " + ", ".join(f"quantile_disc(n, {p / 100})::BIGINT AS p{f'{p:g}'.replace('.', '_')}" for p in (10, 25, 50, 75, 90, 95, 99, 99.9)) + " FROM per"),
    "gt_match_histogram": _er(_groups),
    "gt_cooccurrence": _er("SELECT CASE WHEN n = 0 THEN 'singleton' WHEN n2 > 0 AND n3 > 0 THEN 'both' WHEN n2 > 0 THEN 's2_only' ELSE 's3_only' END AS kind, count(*) AS n FROM per GROUP BY 1"),
}
