"""Tariff expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The standard tariff used for requests without a tariff row.
INCLUDED_MINUTES = 30
EXCESS_RATE = 0.39


def excess_revenue(duration: Column, included: Column, rate: Column) -> Column:
    """Charge for minutes beyond the included ones; 0 when duration is NULL."""
    return F.when(duration > included, (duration - included) * rate).otherwise(F.lit(0.0))


def theoretical_revenue(
    duration: Column, included: int = INCLUDED_MINUTES, rate: float = EXCESS_RATE
) -> Column:
    """Standard-tariff revenue of a ride, never negative."""
    over = duration.cast("double") - F.lit(float(included))
    return F.greatest(F.lit(0.0), over) * F.lit(rate)
