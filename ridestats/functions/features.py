"""Revenue-model features as one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Feature names in model order, and the weekday columns (the
# alphabetically first level, Friday, is the base level and has no column).
NUMERIC_FEATURES = [
    "station_id_encoded", "hour", "is_weekend", "month",
    "temperature_2m", "apparent_temperature", "relative_humidity_2m",
    "bike_type_id", "duracion_minutos", "minutos_incluidos",
    "hour_sin", "hour_cos", "is_rush_hour", "is_night",
    "temp_comfort", "humidity_high", "temp_apparent_diff",
    "duracion_larga", "duracion_normalizada",
]
DAY_LEVELS = ["Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
DAY_FEATURES = [f"day_{d.lower()}" for d in DAY_LEVELS]
FEATURES = NUMERIC_FEATURES + DAY_FEATURES


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _derived() -> dict[str, Column]:
    hour, temp = F.col("hour"), F.col("temperature_2m")
    angle = F.lit(2.0 * math.pi) * hour / F.lit(24.0)
    return {
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_rush_hour": _flag(hour.between(7, 9) | hour.between(17, 19)),
        "is_night": _flag((hour >= 22) | (hour <= 5)),
        "temp_comfort": _flag(temp.between(15, 25)),
        "humidity_high": _flag(F.col("relative_humidity_2m") > 70),
        "temp_apparent_diff": F.col("apparent_temperature") - temp,
        "duracion_larga": _flag(F.col("duracion_minutos") > 45),
        "duracion_normalizada": F.try_divide(
            F.col("duracion_minutos"), F.col("minutos_incluidos").cast("double")
        ),
    }


def feature_matrix(coded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed numeric columns in model order; anything missing is 0.

    ``coded`` is a ride frame that already carries ``station_id_encoded``.
    """
    derived = _derived()

    def value(name: str) -> Column:
        raw = derived.get(name, F.col(name) if name in NUMERIC_FEATURES else None)
        return F.coalesce(raw.cast("double"), F.lit(0.0)).alias(name)

    days = [
        _flag(F.col("day_name") == level).cast("double").alias(name)
        for level, name in zip(DAY_LEVELS, DAY_FEATURES)
    ]
    return coded.select(*keep, *[value(n) for n in NUMERIC_FEATURES], *days)
