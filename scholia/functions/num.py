"""Rounding that agrees between engines: half to even on the scaled double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 0) -> Column:
    return F.rint(c * 10**digits) / 10**digits if digits else F.rint(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))
