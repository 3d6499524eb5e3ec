"""Column helpers for work inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def covered(intervals: Column) -> Column:
    """Number of places inside intervals (pos, length) that are sorted by pos; each place counts once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["pos"], acc["upto"]))).alias("n"),
                        F.greatest(end, acc["upto"]).alias("upto"))

    return F.aggregate(intervals, start, step, lambda acc: acc["n"])
