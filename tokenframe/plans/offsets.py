"""Running totals over a whole table without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def running_offsets(df: DataFrame, order_col: str, size_col: str, start: str = "start", end: str = "end") -> DataFrame:
    """df with start and end: sums of size_col over the rows before, and up to, each row by order_col.

    Rows are range-partitioned by order_col, of any type that orders, and a hash of the row, so that equal keys
    are dealt too; they are stored, and each partition is summed. Only the partitions' totals,
    one row each, are put in order in one place and broadcast. Null sizes count 0; nulls of
    order_col come first.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    own = df.withColumn("__tie", F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])).repartitionByRange(order_col, "__tie")
    own = stored(own.withColumn("__part", F.spark_partition_id()))
    totals = own.groupBy(F.col("__part").alias("__of")).agg(F.sum(size).alias("__total"))
    before = Window.partitionBy(F.lit(0)).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = totals.select("__of", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(F.col(order_col).asc_nulls_first(), "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = own.withColumn("__sum", F.sum(size).over(inside)).join(F.broadcast(totals), F.col("__part") == F.col("__of"))
    upto = F.col("__before") + F.col("__sum")
    return summed.withColumns({start: upto - size, end: upto}).drop("__part", "__tie", "__of", "__before", "__sum")
