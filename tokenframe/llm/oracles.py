"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"


def _islands(repeats: str, span: int) -> str:
    """Maximal runs [lo, hi] of what windows of `span` units cover, from their starts (doc_id, i)."""
    return f"""marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= {span} THEN 0 ELSE 1 END AS opens FROM {repeats} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
    runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + {span - 1} AS hi FROM numbered GROUP BY doc_id, run)"""


OP1 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 198)) AS i FROM d),
named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 400)) AS h FROM starts)),
repeats AS (SELECT doc_id, i FROM named WHERE n > 1), {_islands('repeats', 200)},
parts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - 1 - before)), '' ORDER BY lo) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN cuts USING (doc_id)"""

OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d),
named AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM starts)),
repeats AS (SELECT doc_id, i FROM named WHERE n > 1), {_islands('repeats', 20)},
parts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
cuts AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, max(hi) AS last, flatten(list(CASE WHEN lo - 1 > before THEN ws[before + 1:lo - 1] ELSE [] END ORDER BY lo)) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN last IS NULL THEN ws ELSE list_concat(kept, ws[last + 1:]) END, ' ')) AS kept_sha256 FROM d LEFT JOIN cuts USING (doc_id)"""

OP4 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d),
named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM starts)),
repeats AS (SELECT doc_id, i FROM named WHERE n > 1), {_islands('repeats', 5)},
covered AS (SELECT doc_id, sum(hi - lo + 1) AS n FROM runs GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - list_unique(ls) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, n_symbols > CAST(0.25 AS DOUBLE) * n_words AS symbols, n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines AS lines FROM m),
f AS (SELECT *, short OR repeats AS base_failed, short OR repeats OR symbols OR lines AS failed FROM r),
g AS (SELECT source, unnest([{{'rule': 'short', 'most': 0.4, 'bad': short}}, {{'rule': 'repeats', 'most': 0.4, 'bad': repeats}}, {{'rule': 'symbols', 'most': 0.4, 'bad': symbols}}, {{'rule': 'lines', 'most': 0.4, 'bad': lines}}, {{'rule': 'failed', 'most': 0.5, 'bad': failed}}]) AS x FROM f WHERE source IS NOT NULL),
h AS (SELECT source, x.rule AS rule, CAST(max(x.most) AS DOUBLE) AS most, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE x.bad) AS DOUBLE) AS k FROM g GROUP BY source, x.rule),
a AS (SELECT rule, sum(n) AS n, count(*) AS hosts, sum(n * n) AS nn, sum(k) / sum(n) AS rate, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(k * k / n) AS squares FROM h GROUP BY rule),
b AS (SELECT rule, rate, mean, (squares - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / greatest(n - nn / n, 1e-9) AS between_ FROM a),
p AS (SELECT rule, rate, mean, CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1), 1e6) ELSE 1e6 END AS strength FROM b),
v AS (SELECT source, bool_or((k + strength * mean) / (n + strength) > most AND k / n > rate) AS rejected FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected FROM f LEFT JOIN v USING (source)"""

ORACLE_SQL = {"op1_suffix_array_dedup": OP1, "op4_quality_rules": OP4, "op9_substring_dedup": OP9}
