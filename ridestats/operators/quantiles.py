"""Exact interpolated quantiles without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SMALL_COLUMN = 100_000  # values one aggregate state may hold
_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], p: float, small: int = SMALL_COLUMN
) -> dict[str, float | None]:
    """Interpolated quantile ``p`` of each column, NULLs ignored.

    Columns of checked small size go through one exact aggregate. Longer ones
    are narrowed: a mergeable sketch brackets the wanted rank, the bracket is
    verified by counting (both for all columns at once), and only values inside it
    are looked at again.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    result: dict[str, float | None] = {c: None for c in columns}
    short = [c for c in columns if 0 < counts[c] <= small]
    if short:
        row = df.agg(*[F.percentile(c, F.lit(p)).alias(c) for c in short]).first()
        result.update({c: row[c] for c in short})
    long = [c for c in columns if counts[c] > small]
    brackets = _brackets(df.select(*[F.col(c).cast("double").alias(c) for c in long]), long, counts, p)
    for c in long:
        values = df.select(F.col(c).cast("double").alias("v"))
        result[c] = _narrow(values, counts[c], p, small, brackets[c])
    return result


def _range(first: int, last: int, below: int, size: int) -> list[float]:
    """Shares between which the sketch is sure to see the wanted ranks, or nearly so."""
    margin = 2.0 / _ACCURACY
    return [max(0.0, (first - below) / size - margin), min(1.0, (last + 1 - below) / size + margin)]


def _brackets(df: DataFrame, columns: Sequence[str], counts, p: float) -> dict[str, tuple]:
    """(low, high, values below, values inside) of every column: one sketch pass, one count pass."""
    if not columns:
        return {}

    def shares(c: str) -> list[float]:
        rank = p * (counts[c] - 1)
        return _range(math.floor(rank), math.ceil(rank), 0, counts[c])

    ends = df.agg(*[F.percentile_approx(c, shares(c), _ACCURACY).alias(c) for c in columns]).first()
    inside = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c) < ends[c][0]), F.count_if(F.col(c).between(ends[c][0], ends[c][1]))
            ).alias(c)
            for c in columns
        ]
    ).first()
    return {c: (*ends[c], *inside[c]) for c in columns}


def _narrow(values: DataFrame, n: int, p: float, small: int, bracket: tuple | None) -> float:
    rank = p * (n - 1)
    first, last = math.floor(rank), math.ceil(rank)
    inside = values.filter(F.col("v").isNotNull())
    below, size = 0, n
    while True:
        if bracket is None:
            low, high = inside.agg(
                F.percentile_approx("v", _range(first, last, below, size), _ACCURACY).alias("b")
            ).first()["b"]
            under, within = inside.agg(
                F.count_if(F.col("v") < low).alias("u"),
                F.count_if(F.col("v").between(low, high)).alias("w"),
            ).first()
        else:
            (low, high, under, within), bracket = bracket, None
        if below + under > first or below + under + within <= last:
            # The sketch missed the rank: keep the current bracket, split by value counts.
            low, high = inside.agg(F.min("v"), F.max("v")).first()
            under, within = 0, size
        inside = inside.filter(F.col("v").between(low, high))
        below, size = below + under, within
        if low == high:
            return low
        runs = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if runs.limit(small + 1).count() <= small:
            return _pick(runs, first - below, last - below, rank - below)


def _pick(runs: DataFrame, first: int, last: int, rank: float) -> float:
    # At most ``small`` (value, count) pairs, checked by the caller.
    seen, found = 0, {}
    for value, n in runs.orderBy("v").collect():
        for want in (first, last):
            if seen <= want < seen + n:
                found[want] = value
        seen += n
    if found[first] == found[last]:
        return found[first]
    # The weights of the exact aggregate, so that both ways agree to the last bit.
    return (last - rank) * found[first] + (rank - first) * found[last]
