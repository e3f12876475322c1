"""Operational reports over the trip mart.

Group keys that are NULL are left out of the roll-ups, and the sum of a group
without values is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import equal_width_bin, finite, histogram_bin, sum0
from ..functions.text import title_case
from ..sources.scratch import stage

REVENUE = "ingreso_min_excedente"
STATION = "start_station_id"


def kpis(mart: DataFrame) -> DataFrame:
    """Headline figures in one pass; NULL revenue counts as not paying."""
    paying = F.coalesce(F.col(REVENUE) > 0, F.lit(False)).cast("int")
    return mart.agg(
        F.count(F.lit(1)).alias("total_viajes"),
        sum0(REVENUE).alias("ingresos_totales"),
        F.avg(REVENUE).alias("ingreso_promedio"),
        F.count_distinct(STATION).alias("estaciones_activas"),
        (F.avg(paying) * 100).alias("viajes_con_ingresos"),
    )


def dataset_stats(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct(STATION).alias("unique_stations"),
    )


def revenue_by(mart: DataFrame, dimension: str) -> DataFrame:
    """Total, mean and number of revenues per value of one mart column."""
    return (
        mart.where(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(
            sum0(REVENUE).alias("total_revenue"),
            F.avg(REVENUE).alias("avg_revenue"),
            F.count(REVENUE).alias("trip_count"),
        )
    )


def station_balance(mart: DataFrame) -> DataFrame:
    """Departures, arrivals and net bikes per station, from one pass.

    Every trip yields a departure leg and an arrival leg, which are summed
    together; a station with legs of one kind only has 0 of the other.
    """
    leg = F.explode(
        F.array(
            F.struct(F.col("start_station_id").alias("station_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
            F.struct(F.col("end_station_id").alias("station_id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
        )
    )
    return (
        mart.select(leg.alias("leg")).select("leg.*")
        .where(F.col("station_id").isNotNull())
        .groupBy("station_id")
        .agg(F.sum("out").alias("departures"), F.sum("in").alias("arrivals"))
        .withColumn("balance", F.col("arrivals") - F.col("departures"))
        .withColumn("abs_balance", F.abs("balance"))
    )


def station_balance_top(balance: DataFrame, n: int = 20) -> DataFrame:
    """Stations with the largest imbalance either way."""
    return balance.orderBy(F.desc("abs_balance"), "station_id").limit(n)


def station_balance_extremes(balance: DataFrame, n: int = 10) -> DataFrame:
    """The largest deficits and the largest surpluses."""
    deficit = balance.orderBy("balance", "station_id").limit(n).withColumn("side", F.lit("deficit"))
    surplus = balance.orderBy(F.desc("balance"), "station_id").limit(n).withColumn("side", F.lit("surplus"))
    return deficit.unionByName(surplus).select("side", "station_id", "departures", "arrivals", "balance")


def weather_impact(mart: DataFrame, bins: int = 10) -> DataFrame:
    """Revenue and duration over equal-width temperature bins.

    One narrow pass finds the range, a second bins every trip where it is and sums
    per bin. Temperatures that are not finite numbers count for nothing.
    """
    trips = mart.select(
        finite(F.col("temperature_2m").try_cast("double")).alias("t"), REVENUE, "duracion_minutos"
    ).where(F.col("t").isNotNull())
    low, high = trips.select(F.min("t")).scalar(), trips.select(F.max("t")).scalar()
    return (
        trips.withColumn("temp_bin", equal_width_bin(F.col("t"), low, high, bins))
        .groupBy("temp_bin")
        .agg(
            F.avg(REVENUE).alias("avg_revenue"),
            sum0(REVENUE).alias("total_revenue"),
            F.count(REVENUE).alias("trip_count"),
            F.avg("t").alias("avg_temperature"),
            F.avg("duracion_minutos").alias("avg_duration"),
        )
    )


def weather_chart(impact: DataFrame) -> DataFrame:
    """The weather bins with chart rounding."""
    return impact.select(
        F.round("avg_temperature", 1).alias("temperature"),
        F.round("avg_revenue", 2).alias("avg_revenue"),
        F.round("total_revenue", 2).alias("total_revenue"),
        "trip_count",
        F.round("avg_duration", 1).alias("avg_duration"),
    )


def user_distribution(mart: DataFrame) -> DataFrame:
    """Trips per member type, names in title case."""
    return (
        mart.where(F.col("member_casual").isNotNull())
        .groupBy("member_casual")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(title_case(F.col("member_casual")).alias("name"), "value")
    )


def value_histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram of a column's finite values, their mean on every row.

    The column is written once, as it may be costly to compute: then come one narrow pass
    for range and mean, and one that bins the values where they are.
    """
    finites = stage(values.select(finite(F.col(column)).alias("v")).where(F.col("v").isNotNull()), "values")
    low, high, mean = (F.lit(x).cast("double") for x in finites.agg(F.min("v"), F.max("v"), F.avg("v")).first())
    width = (high - low) / F.lit(float(bins))
    return (
        finites.withColumn("bin", histogram_bin(F.col("v"), low, high, bins))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select("bin", (low + F.col("bin") * width).alias("bin_start"), "frequency", mean.alias("mean_value"))
    )
