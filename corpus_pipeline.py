"""The corpus pipeline: five stages from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenframe.llm import langid, mixing, sentencepieces, shingles, suffix_dedup
from tokenframe.llm.common import numbered, shared_folder, table, unused

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; lang becomes the recognised one.

    Texts without a letter and those whose posterior is under LEAST_SCORE are rejected.
    """
    own = docs.select(F.col("doc_id").alias("id"), "text", "lang").where(langid.fold("id", 3) != 1)
    out = unused(docs, "lang_id")
    got = langid.predict(docs, langid.fit(own), out=out)
    kept = got.where((F.col(out).lang_pred != "und") & (F.col(out).score >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(out).lang_pred).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least row number in each component of near-duplicates.

    Links are a likeness of five-word shingles of 0.8 or more. Rows are numbered in the order of
    doc_id, so that rows that repeat an id, or have none, are documents of their own.
    """
    own = numbered(docs, "doc_id", "text")
    kept = own.join(shingles.leaders(own.select("id", "text")), "id", "left_semi")
    return kept.select("rest.*", "text").select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 200 and more that occur more than once; documents left without a word go."""
    return suffix_dedup.rewrite(docs).where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target words."""
    n, copy = unused(docs, "copies"), unused(docs, "copy")
    takes = mixing.with_copies(docs, out=n).where(F.col(n) > 0)
    return takes.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text that the mix holds."""
    return docs.select("doc_id", "source", sentencepieces.digests(F.col("text")).alias("d")).select("doc_id", "source", "d.*")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("tokens", tokens),
]

ORACLE_SQL = None  # fingerprint components and merges have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
