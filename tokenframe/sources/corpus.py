"""Readers of corpora as (row_id, text) DataFrames, and writers of encoded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, id_col: str, text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))


def text_files(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row for each line, or with `whole` for each file; row_id is the file's path (and `line` a
    number that grows along a file)."""
    read = spark.read.option("wholetext", whole).text(path)
    own = read.select(F.col("_metadata.file_path").alias("row_id"), F.col("value").alias("text"))
    return own if whole else own.withColumn("line", F.monotonically_increasing_id())


def long_contexts(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with a long `context` each."""
    return spark.read.option("multiLine", True).json(path).select(F.col("_id").alias("row_id"), F.col("context").alias("text"))


def chats(spark: SparkSession, path: str) -> DataFrame:
    """JSON records {id, conversations: [{from, value}]}, rendered "[role]: value" in turn order, with
    a blank line between."""
    turn = lambda t: F.concat(F.lit("["), t["from"], F.lit("]: "), t["value"])
    return spark.read.option("multiLine", True).json(path).select(F.col("id").alias("row_id"), F.array_join(F.transform("conversations", turn), "\n\n").alias("text"))


def rendered(conversations: DataFrame) -> DataFrame:
    """The same from a table (conv_id, turn, role, text): conv_id, text."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns.line"), "\n\n").alias("text"))


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A streaming DataFrame over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
