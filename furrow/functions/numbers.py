"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(number: Column, digits: int) -> Column:
    """Round as numpy does: scale, take the nearest whole number (the even one of two), scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(number * scale) / scale
