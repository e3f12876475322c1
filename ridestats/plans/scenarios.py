"""Scenario grids and shortage counterfactuals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import key_text, milli, normal, uniform
from ..functions.numeric import sum0
from ..operators.expand import repeat_rows
from ..operators.sampling import seeded_sample

# Grid ranges, held values, ride duration spread and limits.
HOURS = (0, 23, 1)
TEMPERATURES = (5, 35, 5)
DURATIONS = (20, 80, 10)
HELD_HOUR, HELD_TEMPERATURE, HELD_DURATION = 17, 20, 35
GRID_HUMIDITY = 60.0
DURATION_SPREAD, SHORTEST, LONGEST = 15.0, 10.0, 120.0
SEED = 42
BASE = ["station_id", "month", "bike_type"]


def _axis(span: tuple[int, int, int], held: int, vary: bool, dtype: str = "int") -> Column:
    low, high, step = span
    values = F.sequence(F.lit(low), F.lit(high), F.lit(step)) if vary else F.array(F.lit(held))
    return F.explode(values.cast(f"array<{dtype}>"))


def grid(
    bases: DataFrame,
    vary_hour: bool = True,
    vary_temperature: bool = True,
    vary_duration: bool = True,
) -> DataFrame:
    """Scoring requests: every hour, temperature and duration of each base.

    ``bases`` has one row per station, month and bike type to look at. The few rows
    are dealt out by their key first, so that they are expanded all over the
    cluster and what ranks or sums a base need not move again.
    """
    parts = int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        bases.select(*BASE)
        .repartition(parts, "station_id")  # enough for whatever groups by a base
        .withColumn("hour", _axis(HOURS, HELD_HOUR, vary_hour))
        .withColumn("temperature", _axis(TEMPERATURES, HELD_TEMPERATURE, vary_temperature, "double"))
        .withColumn("duration", _axis(DURATIONS, HELD_DURATION, vary_duration, "double"))
        .withColumn("is_weekend", F.lit(False))
        .withColumn("humidity", F.lit(GRID_HUMIDITY))
    )


def grid_top(scored: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best scenarios of each base; ties in grid order."""
    # A partition is one base: 1,176 scenarios at most.
    best_first = Window.partitionBy(*BASE).orderBy(
        F.desc_nulls_last("prediction"), "hour", "temperature", "duration"
    )
    return scored.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= n)


def grid_stats(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*BASE).agg(
        F.max("prediction").alias("max_prediction"),
        F.avg("prediction").alias("avg_prediction"),
        F.count_if(F.col("prediction") > 0).alias("profitable_scenarios"),
        F.count(F.lit(1)).alias("total_scenarios"),
    )


def _event_key() -> list[Column]:
    return [F.col("station_id"), F.col("time_id"), milli(F.col("balance_net"))]


def lost_trips(
    events: DataFrame,
    max_events: int | None = None,
    max_trips: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One simulated ride per lost trip of each event, as scoring requests.

    All events and trips are simulated unless ``max_events`` (a seeded sample)
    or ``max_trips`` (per event) limits them. Durations are normal around the
    station mean, bikes follow the station's share; both depend on the event,
    the trip number and the seed only.
    """
    if max_events is not None:
        events = seeded_sample(events, max_events, _event_key(), seed)
    trips = F.col("viajes_perdidos_estimados").cast("bigint")
    if max_trips is not None:
        trips = F.least(trips, F.lit(max_trips))
    rides = repeat_rows(events, trips, "trip_no")
    ride_key = key_text([*_event_key(), F.col("trip_no")])
    drawn = normal(ride_key, F.col("duracion_promedio_estacion"), DURATION_SPREAD, seed, "duration")
    clamped = F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), drawn))
    bike = F.when(uniform(ride_key, seed, "bike") < F.col("prop_bike_type_1"), 1).otherwise(2)
    return rides.select(
        "station_id", "time_id", "balance_net", "trip_no", "hour", "is_weekend", "month", "day_name",
        F.col("temperature_2m").alias("temperature"),
        F.col("relative_humidity_2m").alias("humidity"),
        bike.alias("bike_type"),
        F.round(clamped, 6).alias("duration"),
    )


def counterfactual_loss(
    events: DataFrame, scored: DataFrame, max_events: int | None = None
) -> DataFrame:
    """Loss and lost trips, scaled from the simulated events to all of them."""
    found = events.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("station_id").alias("stations")
    )
    total = found.select("events").scalar()
    used = total if max_events is None else F.least(total, F.lit(max_events))
    factor = F.coalesce(F.try_divide(total, used), F.lit(1.0))
    sums = scored.agg(sum0("prediction").alias("loss"), F.count(F.lit(1)).alias("trips"))
    return sums.select(
        (F.col("loss") * factor).alias("total_loss"),
        (F.col("trips") * factor).alias("lost_trips"),
        F.coalesce(F.try_divide(F.col("loss"), F.col("trips")), F.lit(0.0)).alias("loss_per_trip"),
        found.select("stations").scalar().alias("affected_stations"),
        total.alias("events_analyzed"),
        used.alias("sample_size"),
        factor.alias("scaling_factor"),
    )


def counterfactual(
    events: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    max_events: int | None = None,
    max_trips: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Loss of all events: simulate, ``score`` and scale in one call.

    ``score`` turns requests into rows with a ``prediction``, like
    ``revenue.score`` with a model or ``revenue.tariff_score``. Adds the number of
    simulated trips before scaling.
    """
    scored = score(lost_trips(events, max_events, max_trips, seed))
    loss = counterfactual_loss(events, scored, max_events)
    simulated = F.round(F.col("lost_trips") / F.col("scaling_factor")).cast("bigint")
    return loss.withColumn("simulated_trips", simulated)


def shortage_top(events: DataFrame, n: int = 10) -> DataFrame:
    """Events with the most lost trips."""
    return events.orderBy(
        F.desc_nulls_last("viajes_perdidos_estimados"), "station_id", "time_id", "balance_net"
    ).limit(n)


def loss_by_station(events: DataFrame, total_loss: DataFrame, n: int = 10) -> DataFrame:
    """The total loss shared out by lost trips; the ``n`` stations hit most.

    ``total_loss`` is a one-row frame with the loss as its only column.
    """
    per_station = (
        events.where(F.col("station_id").isNotNull())
        .groupBy("station_id")
        .agg(sum0("viajes_perdidos_estimados").alias("viajes_perdidos"))
    )
    all_trips = events.select(F.sum("viajes_perdidos_estimados")).scalar()
    rate = F.try_divide(total_loss.scalar(), all_trips)
    return (
        per_station.withColumn("ingresos_perdidos", F.col("viajes_perdidos") * rate)
        .orderBy(F.desc_nulls_last("ingresos_perdidos"), "station_id")
        .limit(n)
    )
