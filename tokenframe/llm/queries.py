"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hostrules, htmltext, langid, minhash, mixing, quality, sentencepieces, simhash, substring_dedup, suffix_dedup
from .common import table
from .oracles import ORACLE_SQL


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", sentencepieces.digests(F.col("text")).alias("d")).select("doc_id", "d.*")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.texts(table(spark, sf_dir, "pages"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_language_id, op3_simhash_near_dedup, op4_quality_rules, op5_sentencepiece,
        op6_html_extraction, op7_document_fingerprints, op8_source_mixing, op9_substring_dedup,
        op10_quality_classifier,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
