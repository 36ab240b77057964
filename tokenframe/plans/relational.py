"""Relational queries around tokenized text: joins, grouping sets, ranks, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_pieces(df: DataFrame, pieces: Column, n: int) -> DataFrame:
    """piece, n: the most frequent ones; counts are combined before the shuffle."""
    return df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(n)


def unknown_characters(df: DataFrame, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """char, n: characters of the corpus that are no token (an anti-join of distinct characters)."""
    chars = df.select(F.explode(F.split(text_col, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    return chars.join(vocab.select("token"), F.col("char") == F.col("token"), "left_anti")


def stats_cube(df: DataFrame) -> DataFrame:
    """Documents and tokens (column n) by source, language, both and all."""
    return df.cube("source", "lang").agg(F.grouping_id("source", "lang").alias("level"), F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """source, token_id, n, rank: each source's most frequent tokens. The window sees counts only:
    at most a vocabulary for each source."""
    counts = rows.groupBy("source", "token_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "token_id")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def packed(flat: DataFrame, width: int) -> DataFrame:
    """Where each row of a flat batch lies when ids fill contexts of `width` in order."""
    w = F.lit(width)
    own = flat.where("end > start")
    return own.select("doc_id", F.floor(F.col("start") / w).alias("first_context"), F.floor((F.col("end") - 1) / w).alias("last_context"), (F.col("start") % w).alias("place"))


def grams(text: Column, n: int) -> Column:
    """array<string>: runs of n words."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    of = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.transform(F.array(words), of).getItem(0)


def shared_grams(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, item_id, shared: distinct runs of n words that a document and an item share."""
    theirs = items.select("item_id", F.explode(F.array_distinct(grams(F.col("text"), n))).alias("gram"))
    ours = documents.select("doc_id", F.explode(F.array_distinct(grams(F.col("text"), n))).alias("gram"))
    return ours.join(theirs, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def merged(encoded: DataFrame, key: str, order: str) -> DataFrame:
    """Encodings of a key's rows put together in order: key, ids, n_sequences. The parts of one key
    (a conversation) are gathered in one row, which the result is anyway."""
    parts = encoded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "ids"))).alias("parts"), F.count("*").alias("n_sequences"))
    return parts.select(key, F.flatten("parts.ids").alias("ids"), "n_sequences")
