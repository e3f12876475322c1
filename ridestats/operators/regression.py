"""Regression quality as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def metric_columns(label: Column, prediction: Column) -> list[Column]:
    """RMSE, MAE and R2 in one pass; R2 is NULL for a constant label."""
    error = label - prediction
    spread = F.var_pop(label) * F.count(label)
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias("r2"),
    ]


def regression_metrics(
    scored: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()
) -> DataFrame:
    metrics = metric_columns(F.col(label), F.col(prediction))
    return scored.groupBy(*by).agg(*metrics) if by else scored.agg(*metrics)
