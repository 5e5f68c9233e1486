"""Money stays decimal; the division comes last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def views_value(views: Column, rate: Column) -> Column:
    """views * rate per thousand, not yet divided; null counts as nothing."""
    return F.coalesce(views, F.lit(0)).cast("decimal(18,0)") * F.coalesce(rate, F.lit(0).cast("decimal(18,4)"))


def earning(value: Column) -> Column:
    """views / 1000 * rate from views_value or its sum: exact decimals until it is rounded to four places, then a double."""
    return F.round(value.cast("decimal(30,4)") * F.lit("0.001").cast("decimal(4,3)"), 4).cast("double")
