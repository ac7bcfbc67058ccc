"""Rounding as SQL engines do it on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """A double to so many decimals: the scaled double is rounded, half away from zero; its decimal text can fall on the other side of a tie."""
    return F.round(x * 10.0**digits) / 10.0**digits
