"""Numeric expressions of the sensor job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transformed_reading_expr(reading: Column | str = "reading") -> Column:
    """``log(|x| + 1) * sin(x)`` as a native expression.

    Null in, null out.  ``|x| + 1 >= 1`` so the logarithm is never undefined;
    NaN and infinite readings give NaN (``sin(inf)`` is NaN), never null, so a
    not-null filter keeps them -- the same as the row function it replaces.
    """
    x = F.col(reading) if isinstance(reading, str) else reading
    return (F.log(F.abs(x) + F.lit(1.0)) * F.sin(x)).cast("double")


def round_double(c: Column | str, digits: int = 6) -> Column:
    """Rounded double for result comparison across engines (libm vs JVM sin)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits)
