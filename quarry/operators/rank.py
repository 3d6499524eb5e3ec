"""``rank()`` within a group without sending a group's rows to one task.

A window over the group sorts all of its rows in a single task.  Here rows are
counted per distinct (group, order) first, so ties are combined before the
shuffle; the counts of wide buckets of the order give the rows before a bucket,
those inside a bucket the rows before a value.  A group then needs one row per
bucket in one task (49,711 days for all 32-bit epoch seconds), a bucket one row
per distinct value (86,400 seconds).  The ranks are joined back by (group,
order), a join whose skewed side AQE splits.  All steps are built-in expressions:
no column of the data goes through Python, and nothing is written.

Orders that no fixed width fits (strings, doubles, dates, decimals, 64-bit
integers) are cut at splitters of the group's own values: of its distinct values
a constant share is drawn by hash, and every ``OVERSAMPLE``-th of those in order
is a splitter.  So a bucket has about ``values_per_bucket`` distinct values,
whatever their type and spread, and a small group has no splitter and one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400


#: Drawn values to a splitter: the more, the more even are the buckets.
OVERSAMPLE = 64


def fixed_buckets(value: Column, kind: T.DataType, width: int) -> Column | None:
    """A number that rises with the value: short integers and instants by width; None for other types."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.floor(value / F.lit(width))
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_seconds(value) / F.lit(width))
    return None


def places_before(sorted_values: Column, value: Column) -> Column:
    """How many of the sorted values are at most ``value``, by bisection."""
    size = F.size(sorted_values)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + F.lit(1))).cast("int") + 1)
    bounds = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(sorted_values, middle) <= value
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(middle).alias("hi")))

    return F.aggregate(steps, bounds, halve, lambda acc: acc["lo"])


def with_splitter_buckets(counts: DataFrame, values_per_bucket: int) -> DataFrame:
    """``counts`` (one row per distinct ``__o`` of a group ``__g``) with ``__b``, a number that rises with ``__o``; nulls first."""
    drawn = counts.filter(F.col("__o").isNotNull() & (F.pmod(F.xxhash64("__o", F.lit(29)), F.lit(values_per_bucket)) < OVERSAMPLE))
    splitters = drawn.groupBy(F.col("__g").alias("__sg")).agg(F.sort_array(F.collect_list("__o")).alias("__s")) \
        .filter(F.size("__s") >= OVERSAMPLE).withColumn("__s", F.transform(
            F.sequence(F.lit(OVERSAMPLE - 1), F.size("__s") - 1, F.lit(OVERSAMPLE)), lambda i: F.get("__s", i)))
    joined = counts.join(splitters, F.col("__g").eqNullSafe(F.col("__sg")), "left")
    bucket = F.when(F.col("__o").isNull(), F.lit(-1)).when(F.col("__s").isNull(), F.lit(0)).otherwise(places_before(F.col("__s"), F.col("__o")))
    return joined.withColumn("__b", bucket).drop("__sg", "__s")


def rank_within(df: DataFrame, group: str, order: str, out: str, strategy: str = "auto", bucket_width: int = DAY,
                values_per_bucket: int = 1 << 18) -> DataFrame:
    """``df`` with ``out``: ``rank()`` per ``group`` by ascending ``order``, nulls first; a null group is a group.

    ``strategy="window"`` is the plain window, for groups that are known to be small.
    """
    if strategy == "window":
        w = Window.partitionBy(group).orderBy(F.col(order).asc_nulls_first())
        return df.withColumn(out, F.rank().over(w))
    counts = df.groupBy(F.col(group).alias("__g"), F.col(order).alias("__o")).agg(F.count("*").alias("__n"))
    fixed = fixed_buckets(F.col("__o"), df.schema[order].dataType, bucket_width)
    counts = with_splitter_buckets(counts, values_per_bucket) if fixed is None else counts.withColumn("__b", fixed)

    def rows_before(*keys: str, by: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_first())
        return F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    buckets = counts.groupBy("__g", "__b").agg(F.sum("__n").alias("__n")).select(
        F.col("__g").alias("__bg"), F.col("__b").alias("__bb"), rows_before("__g", by="__b").alias("__earlier"))
    inside = counts.withColumn("__inside", rows_before("__g", "__b", by="__o"))
    ranks = inside.join(buckets, F.col("__g").eqNullSafe(F.col("__bg")) & F.col("__b").eqNullSafe(F.col("__bb"))).select(
        "__g", "__o", (F.col("__earlier") + F.col("__inside") + 1).cast("int").alias("__rank"))
    joined = df.join(ranks, df[group].eqNullSafe(ranks["__g"]) & df[order].eqNullSafe(ranks["__o"]))
    return joined.select(*[df[c] for c in df.columns if c != out], ranks["__rank"].alias(out))
