"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a session on a cluster is refused, and one
    in a single process (as in tests) gets a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder and cut its lineage.

    The shuffles behind it are of no use any more; the collection lets Spark delete their files.
    """
    spark = df.sparkSession
    shared_folder(spark)
    df = df.checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return df


_holder: list = []


def claim(owner: object, forget: Callable[[], None] = bool) -> None:
    """Called in a worker by each operator: what another one kept there is dropped and given back to
    the system, so that a worker which serves several stages holds one operator's memo at a time."""
    if _holder and _holder[0] is owner:
        return
    if _holder:
        _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _holder[:] = [owner, forget]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rest, text): id is unique and in the order of id_col, rest holds the other columns.

    It is id_col itself where that is a whole number, unique and never null. Otherwise rows are
    numbered in the order of (id_col, hash of the text), nulls first, by a range partitioning.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    own = docs.select(F.col(id_col).alias("given"), rest.alias("rest"), F.col(text_col).alias("text"))
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    if whole and own.groupBy("given").agg(F.count("*").alias("n")).where("n > 1 or given is null").isEmpty():
        return own.select(F.col("given").cast("long").alias("id"), "rest", "text")
    order = ["given", F.xxhash64("text")]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.select(F.monotonically_increasing_id().alias("id"), "rest", "text"))


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """df with a long column `out`: the place of each row, from 0, in the order of the columns `by`,
    found by a range partitioning; one count for each partition is broadcast."""
    placed = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))  # one row for each partition
    parts = parts.select("_of", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_of")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1 + F.col("_before")
    return placed.join(F.broadcast(parts), F.col("_part") == F.col("_of")).withColumn(out, place.cast("long")).drop("_part", "_of", "_before")


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and each text's offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes each, one row at least."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        out.append((first, min(last, n)))
        first = out[-1][1]
    return out
