"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import CERTAINTY, MAX_PRIOR, MIN_PRIOR, SOFT_DUP_LINES, SOFT_SYMBOLS, SOFT_WORD_LENGTH

RULES = ("base", "symbols", "lines", "length")
FAILS = f"""[n_words < 10 OR 100 * n_repeat_words > 20 * n_words, n_symbols > {SOFT_SYMBOLS} * greatest(n_words, 1), n_dup_lines > {SOFT_DUP_LINES} * greatest(n_lines, 1),
    word_chars / greatest(n_words, 1) < {SOFT_WORD_LENGTH[0]} OR word_chars / greatest(n_words, 1) > {SOFT_WORD_LENGTH[1]}]"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS lines FROM d),
v AS (SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS key FROM w, unnest(range(1, len(words) - 3)) r(i)),
c AS (SELECT rid, i FROM v QUALIFY count(*) OVER (PARTITION BY rid, key) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM c, range(5) s(k) GROUP BY rid),
m AS (SELECT rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x09-\x0D ]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, {FAILS} AS fails FROM m),
h AS (SELECT source, k, count(*) AS n, sum(CASE WHEN fails[k] THEN 1 ELSE 0 END) AS failed FROM f, range(1, 5) s(k) GROUP BY source, k),
p AS (SELECT k, sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) - sum(failed) / sum(n) * (1 - sum(failed) / sum(n)) * avg(1.0 / n) AS real FROM h GROUP BY k),
q AS (SELECT *, CASE WHEN real > mean * (1 - mean) / {MAX_PRIOR + 1} THEN greatest(mean * (1 - mean) / real - 1, {MIN_PRIOR}) ELSE {MAX_PRIOR} END AS weight FROM p),
s AS (SELECT source, k, mean, n + weight AS total, (failed + mean * weight) / (n + weight) AS shrunk FROM h JOIN q USING (k)),
bad AS (SELECT source, list(k) AS rules FROM s WHERE shrunk > mean AND (shrunk * (1 - shrunk) <= 0 OR (shrunk - mean) / sqrt(shrunk * (1 - shrunk) / (total + 1)) > {CERTAINTY}) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] AS base_failed,
    NOT fails[1] AND len(list_filter(coalesce(rules, []), lambda k: fails[k])) = 0 AS kept
FROM f LEFT JOIN bad ON f.source IS NOT DISTINCT FROM bad.source"""

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ("assign", ASSIGN, f"length(regexp_extract(x, '{ASSIGN}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(x) >= 20"),
    ("hex", "[0-9a-f]+", "length(x) >= 24"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("google", "AIza[A-Za-z0-9_-]{35}", "true"),
    ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
)
FOUND = " UNION ALL ".join(
    f"""SELECT rid, {place} AS place, '{kind}' AS kind, x, s, s + length(x) AS e FROM (SELECT rid, m[i] AS x, list_sum(list_transform(g[1 : i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: length(z))), 0) AS s
    FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) r(i)) WHERE {good}"""
    for place, (kind, pattern, good) in enumerate(PATTERNS)
)
SPELLED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
BASE = "kind IN ('assign', 'access', 'hex')"

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({FOUND}),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {SPELLED} FILTER ({BASE}) AS own, {SPELLED} AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"


LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms_sql('text')} AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
t AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
q AS (SELECT qid, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS qid, item_id, unnest({terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product quantisation with every distance computed, one pair of tables for each round."""
    steps = [
        """v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT rid, vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM v, range({parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, part, x, min({{'d': CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), 'e': entry}}) AS best
    FROM p JOIN b{k} USING (part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT part, best.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) r(i) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.e)""")
    steps.append(f"o AS (SELECT rid, vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} JOIN v USING (rid) GROUP BY ALL)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


CODES = codes_sql()
