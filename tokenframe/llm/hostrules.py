"""Quality rules with verdicts by host.

Rules are measured on each whole text. Their failures are counted by host (the document's source),
and every host's failure rate of a rule is shrunk towards an empirical beta prior of that rule, fitted by
moments over the hosts: a host of few documents stays near the prior, a large one near its own rate.
A host is rejected if its shrunk rate of any rule exceeds that rule's limit and its own rate that of the whole
corpus: a few bad documents don't condemn it, and neither does the prior. The verdicts are joined
back: a document is kept if it passes the base rules and its host isn't rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SYMBOLS = re.compile(r"[#*$%&|<>]")
RULES = ("short", "repeats", "symbols", "lines")
LIMITS = {"short": 0.4, "repeats": 0.4, "symbols": 0.4, "lines": 0.4, "failed": 0.5}  # of a host's shrunk rate; failed: any rule
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measures(text: str, width: int = 5) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    covered = 0
    if len(words) >= width:
        windows = list(zip(*(words[i:] for i in range(width)), strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    covered += i + width - max(end, i)
                    end = i + width
    chars = sum(map(len, words)) - sum((x & 0xC0) == 0x80 for x in raw) if not raw.isascii() else sum(map(len, words))
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), covered, len(lines)


def measured(text: Column) -> Column:
    """Struct of the measures of each text; null counts as empty."""

    @F.arrow_udf(FIELDS)
    def run(column: pa.Array) -> pa.Array:
        rows = [measures(t or "") for t in column.to_pylist()]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

    return run(text)


def host_rates(failures: DataFrame, rules=(*RULES, "failed")) -> DataFrame:
    """host, n, the failures and the shrunk rate of each rule, and whether the host's own rate is
    over that of all documents (<rule>_over), from rows (host, <rule> boolean ...).

    The prior of a rule is the beta distribution whose mean is the rate over all documents and
    whose strength comes from the variance of host rates beyond that of sampling (moments); it
    is at least 1 and at most a million documents strong.
    """
    hosts = cut(failures.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules]))
    part = [x for r in rules for x in (F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_square"))]
    t = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), *part).first()
    n, k = t["n"] or 1, t["hosts"] or 0
    out = hosts
    for r in rules:
        rate = (t[r] or 0) / n
        mean = min(max(rate, 1e-6), 1 - 1e-6)
        spread = (t[f"{r}_square"] or 0) - n * mean * mean  # sum of n * (rate - mean)^2
        between = (spread - (k - 1) * mean * (1 - mean)) / max(n - (t["nn"] or 0) / n, 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
        out = out.withColumns({f"{r}_rate": (F.col(r) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)), f"{r}_over": F.col(r) / F.col("n") > F.lit(rate)})
    return out.select("host", "n", *rules, *[f"{r}_rate" for r in rules], *[f"{r}_over" for r in rules])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_symbols: float = 0.25, most_lines: float = 0.3, limits: dict[str, float] | None = None) -> DataFrame:
    """id, the measures, base_failed, kept, host_rejected: one row per input row.

    The rules: `short` and `repeats` are the base rules; `symbols` fails with more than most_symbols
    symbols a word, `lines` if over most_lines of the lines repeat one. `limits` gives the
    rates of each rule beyond which a host is rejected; a rate that equals its limit passes.

    Null and empty texts have no words and fail the base rules. Documents of a null host have no
    host verdict against them, and don't count for the prior. Repeated rows each count. A corpus of one host
    has no host that is worse than the rest, so none is rejected.
    """
    limits = LIMITS | (limits or {})
    m = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measured(F.col(text_col)).alias("m")).select("id", "host", "m.*")
    m = m.withColumns({"short": F.expr("n_words < 10"), "repeats": F.expr("100 * n_repeat_words > 20 * n_words")})
    m = m.withColumns({"symbols": F.col("n_symbols") > most_symbols * F.col("n_words"), "lines": F.col("n_dup_lines") > most_lines * F.col("n_lines"), "base_failed": F.expr("short or repeats")})
    m = cut(m.withColumn("failed", F.expr("base_failed or symbols or lines")))
    rates = host_rates(m.where("host is not null"))
    bad = reduce(or_, [(F.col(f"{r}_rate") > limit) & F.col(f"{r}_over") for r, limit in limits.items()])
    verdicts = rates.select(F.col("host").alias("host2"), bad.alias("rejected"))
    rejected = F.coalesce("rejected", F.lit(False))
    return m.join(verdicts, F.col("host") == F.col("host2"), "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), rejected.alias("host_rejected"),
    )
