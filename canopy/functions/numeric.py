"""Comparisons with slack and guarded division; NaN compares as false everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a denominator counts as zero.
SMALL = 1e-10
#: Values closer than this are equal.
CLOSE = 1e-6


def _numbers(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & ~F.isnan(x)
    return out


def is_zero(x: Column) -> Column:
    return _numbers(x) & (F.abs(x) < SMALL)


def is_equal(x: Column, y: Column) -> Column:
    return _numbers(x, y) & ((x == y) | (F.abs(x - y) < CLOSE))


def is_greater(x: Column, y: Column) -> Column:
    return _numbers(x, y) & (x > y + SMALL)


def is_less(x: Column, y: Column) -> Column:
    return _numbers(x, y) & (x < y - SMALL)


def is_greater_or_equal(x: Column, y: Column) -> Column:
    return _numbers(x, y) & (x >= y - SMALL)


def is_less_or_equal(x: Column, y: Column) -> Column:
    return _numbers(x, y) & (x <= y + SMALL)


def is_within(x: Column, low: Column, high: Column) -> Column:
    return is_greater_or_equal(x, low) & is_less_or_equal(x, high)


def safe_div(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, or the default where either is NaN or d is closer to zero than SMALL."""
    bad = F.isnan(n) | F.isnan(d) | (F.abs(d) < SMALL)
    return F.when(bad, F.lit(float(default))).otherwise(n / F.when(bad, F.lit(1.0)).otherwise(d))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def f32(x: Column) -> Column:
    """Narrows to float32, as every stored property is."""
    return x.cast("float")
