"""Result tables with repeated deliveries, invalid values and loosely spelled measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure_key(col: Column | str) -> Column:
    """Letters and digits of a measure's name in lower case; NULL stays NULL."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def valid(col: Column | str) -> Column:
    """True for finite numbers, false for NULL, NaN and infinities."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def entries(df: DataFrame, *cols: str) -> DataFrame:
    """Each id once, with the columns named: rows delivered again agree in all of them.

    The columns are picked before the shuffle and each map task drops its own repetitions first.
    """
    return df.select("id", *cols).distinct()
