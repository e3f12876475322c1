"""Numeric rules shared by all analyses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(column: Column) -> Column:
    """NaN and both infinities as NULL."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def sum0(column: Column | str) -> Column:
    """Sum that is 0, not NULL, over a group without values."""
    return F.coalesce(F.sum(column), F.lit(0))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """0-based right-closed equal-width bin; the minimum is in bin 0.

    Counts the inner edges below the value. A constant column is centred in a
    widened range, which puts every row in the same middle bin.
    """
    step = (high - low) / F.lit(float(bins))
    edges = [F.when(value > F.lit(float(i)) * step + low, 1).otherwise(0) for i in range(1, bins)]
    counted = edges[0]
    for edge in edges[1:]:
        counted = counted + edge
    middle = (bins - 1) // 2
    return F.when(high == low, F.lit(middle)).otherwise(counted)


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based left-closed equal-width bin; the maximum is in the last bin."""
    width = (high - low) / F.lit(float(bins))
    position = F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0))
    return F.least(position, F.lit(bins - 1)).cast("int")
