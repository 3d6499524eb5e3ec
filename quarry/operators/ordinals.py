"""Consecutive numbers in a global order, without a single task.

Rows are sorted over range partitions; a row's number is its place in its
partition plus the rows of the partitions before, of which there is one count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def with_ordinals(df: DataFrame, *order: Column, out: str = "ordinal", start: int = 0) -> DataFrame:
    """``df`` with ``out``: the row's number by ``order``, from ``start``; equal rows get numbers in no fixed order.

    The sorted rows are written once to the shared folder, so the numbers stay
    the same when a task is repeated.  Narrow the rows first: texts can be joined back.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()) \
        .withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    parts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(parts), "_part").withColumn(out, F.col("_at") - F.col("_first") + F.col("_before") + start) \
        .select(*[c for c in df.columns if c != out], out)
