"""Mixing sources to target weights by subset-sum budget fitting.

Per source, documents are counted by exact length. Whole passes over the source fill its target as
far as they go. For the budget that remains, each length gives its proportional number of
documents, the largest lengths fill most of what is left, and a bounded-knapsack dynamic program
over the lengths fits the last words exactly where a subset can. Documents are then selected
by their length's count in seeded order.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, numbered, ranked

CYCLE, MOST = (5, 2, 1), 3
DP_WORDS = 1 << 14


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([len(x.encode().split()) if x else 0 for x in column.to_pylist()], pa.int64())

    return run(text)


def targets(sizes: DataFrame, cycle=CYCLE, most: int = MOST) -> DataFrame:
    """(source, words, target) from (source, words): weights cycle over the sources by code point, the
    one named "" last, and share all words; a target stops at `most` times its source's size, and
    what it leaves is shared again. Sources stay distributed: each round of sharing brings two sums to the driver.
    """
    own = ranked(sizes.withColumn("last", F.col("source") == ""), ["last", "source"], "place").drop("last")
    own = own.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle)).cast("int")))
    own = cut(own.withColumn("cap", most * F.col("words").cast("double")))
    total = float(own.agg(F.sum("words")).first()[0] or 0)
    level = -1.0  # of words for each unit of weight: sources that it takes over their cap are closed
    while True:
        closed = F.col("weight") * level > F.col("cap")
        t = own.agg(F.sum(F.when(closed, F.col("cap"))).alias("caps"), F.sum(F.when(~closed, F.col("weight"))).alias("open")).first()
        now = (total - (t["caps"] or 0.0)) / t["open"] if t["open"] else level
        if now <= level:
            break
        level = now
    return own.select("source", "words", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum comes as near to budget, from below, as the
    dynamic program finds; it is exact for what the greedy part leaves."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    budget = min(budget, total)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    by = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in by:
        more = min(counts[i] - take[i], max(0, rest - DP_WORDS) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    reach, steps, mask = 1, [], (1 << rest + 1) - 1
    for i in reversed(by):
        left, m = counts[i] - take[i], 1
        while left > 0 and lengths[i] * m <= rest and not reach >> rest & 1:
            m = min(m, left)
            steps.append((i, m, reach))
            reach |= reach << lengths[i] * m & mask
            left -= m
            m *= 2
    at = (reach & mask).bit_length() - 1
    for i, m, before in reversed(steps):
        if not before >> at & 1:
            take[i] += m
            at -= m * lengths[i]
    return take


def copies(lengths: list[int], counts: list[int], budget: int, most: int) -> list[int]:
    """How many copies of each length to take: one of a document at first, and up to `most` only
    where a budget can't be reached otherwise."""
    take = knapsack(lengths, counts, budget)
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    if rest > 0 and most > 1:
        more = knapsack(lengths, [c * most - t for c, t in zip(counts, take, strict=True)], rest)
        take = [t + m for t, m in zip(take, more, strict=True)]
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, buckets: int = 1024) -> DataFrame:
    """id_col, size, source_size, target, taken: the words that the mix takes from each document.

    taken is a whole multiple, 0 to 3, of size. A null source is a source of its own, the last; a
    null or empty text has size 0 and nothing to take; rows that repeat an id are documents of
    their own. A length's documents are ranked inside hash buckets, whose counts place each
    bucket, so no group of equal lengths is ordered in one task; a source's distinct lengths are
    fitted in one place.
    """
    key = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col)))
    spot = F.xxhash64(F.lit(seed), F.col(id_col))
    own = cut(docs.select(F.col(id_col).alias("id"), key.alias("source"), word_count(F.col(text_col)).alias("size"), spot.alias("spot")))
    own = own.withColumn("bucket", F.pmod("spot", F.lit(buckets)))
    histogram = cut(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    aims = targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        words, aim = int(group["words"].iloc[0]), float(group["target"].iloc[0])
        base = int(aim / words + 1e-9) if words else 0
        group = group.drop(columns="words").sort_values("size")
        extra = copies(group["size"].tolist(), group["n"].tolist(), round(aim) - base * words, MOST - base)
        return group.assign(base=base, extra=extra, source_size=words)

    plan = histogram.join(aims, "source").groupBy("source").applyInPandas(fit, "source string, size long, n long, base long, extra long, source_size long, target double")
    seen = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = own.groupBy("source", "size", "bucket").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(seen), F.lit(0)))
    places = filled.join(plan, ["source", "size"]).select("source", "size", "bucket", "before", (F.col("base") + F.floor(F.col("extra") / F.col("n"))).alias("base"), (F.col("extra") % F.col("n")).alias("extra"), "source_size", "target")
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("spot", "id")))
    taken = F.col("size") * (F.col("base") + (F.col("before") + F.col("place") <= F.col("extra")).cast("long"))
    return ranked.join(places, ["source", "size", "bucket"]).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "copies", **options) -> DataFrame:
    """docs, all columns, with the number of times that the mix takes each row (0 to 3)."""
    own = numbered(docs, id_col, text_col)
    source = options.pop("source_col", "source")
    got = mix(own.select("id", "text", F.col(f"rest.`{source}`").alias("source")), "id", "text", "source", **options)
    got = got.select(F.col("id").alias("id2"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).alias("n"))
    joined = own.join(got, F.col("id") == F.col("id2"))
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns], F.col("n").alias(out))
