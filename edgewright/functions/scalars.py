"""Small expressions used in several places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(x: Column) -> Column:
    """Logarithm with -inf at 0 and null below, where Spark gives null for both."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log2(x))


def number(x: Column) -> Column:
    """A finite number or null."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n), n)


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def sign_by_threshold(value: Column, threshold: Column) -> Column:
    """1, -1 or 0; a value of exactly 0 that reaches the threshold counts as -1; null gives 0."""
    return F.when(F.abs(value) >= threshold, F.when(value > 0, 1).otherwise(-1)).otherwise(0)


def sign_by_p(value: Column, p: Column, threshold: Column) -> Column:
    return F.when(p <= threshold, F.when(value > 0, 1).otherwise(-1)).otherwise(0)


def color(value: Column, saturation: float = 1.0) -> Column:
    """'r g b' on a ramp from white to (255, 80, 40) for positive, (40, 80, 255) for negative values."""
    share = F.least(F.abs(value) / F.lit(float(saturation)), F.lit(1.0))
    part = lambda up, down: F.round(255 + (F.when(value > 0, up).otherwise(down) - 255) * share).cast("int").cast("string")
    return F.concat_ws(" ", part(255, 40), part(80, 80), part(40, 255))
