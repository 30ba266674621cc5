"""Scalar expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digitize(x: Column, edges: Column) -> Column:
    """Number of edges not above ``x``; NULL for NULL."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e <= x)))


def even_edges(low: Column, high: Column, count: int) -> Column:
    """``count`` evenly spaced values from low to high, both ends exact."""
    step = (high - low) / F.lit(float(count - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.when(i == count - 1, high).otherwise(low + i * step),
    )


def truncate_clamp(x: Column, bound: int = 3) -> Column:
    """Toward zero, then into [-bound, bound], as an integer."""
    towards_zero = F.signum(x) * F.floor(F.abs(x))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), towards_zero)).cast("int")


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of [low, high] cut into equal bins, the last one closed."""
    low, high = _opened(low, high)
    width = (high - low) / F.lit(float(bins))
    return F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")


def bin_width(low: Column, high: Column, bins: int) -> Column:
    low, high = _opened(low, high)
    return (high - low) / F.lit(float(bins))


def bin_left(low: Column, high: Column) -> Column:
    return _opened(low, high)[0]


def _opened(low: Column, high: Column) -> tuple[Column, Column]:
    # a single value gets a bin range of width one around it
    same = low == high
    return F.when(same, low - 0.5).otherwise(low), F.when(same, high + 0.5).otherwise(high)


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation aggregate; NULL for a constant side, where ``corr`` would raise."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def percent_difference(minuend: Column, subtrahend: Column, total: Column) -> Column:
    return F.try_divide((minuend - subtrahend) * F.lit(100.0), total)
