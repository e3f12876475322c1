"""The ride star seen in order tables.

Lines of orders stand in for rides: a line leaves its supplier's nation
(start station) for its customer's nation (end station), the ship date and line
number give the hour, the market segment the member type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import stage

_calendars: dict[tuple[str, str], DataFrame] = {}


def _time_id() -> Column:
    ship = F.col("l_shipdate")
    stamp = F.year(ship) * 1_000_000 + F.month(ship) * 10_000 + F.dayofmonth(ship) * 100
    return (stamp + F.col("l_linenumber") * 3).cast("bigint")


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar of the ship dates; written once per session and folder.

    A derived dimension has no size that Catalyst could know before running it;
    as a written table it is broadcast only if it is small.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _calendars:
        ship = F.col("l_shipdate")
        hours = spark.read.parquet(f"{folder}/lineitem.parquet").select(
            _time_id().alias("time_id"),
            (F.col("l_linenumber") * 3).alias("hour"),
            F.date_format(ship, "EEEE").alias("day_name"),
            (F.weekday(ship) >= 5).alias("is_weekend"),
            F.month(ship).alias("month"),
            (F.lit(2023) + F.year(ship) % 2).alias("year"),
        )
        _calendars[key] = stage(hours.distinct(), "calendar")
    return _calendars[key]


def order_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six star tables over ``lineitem orders customer supplier nation``."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    # Each dimension joins as the file it is: Catalyst knows its size, while it
    # takes the result of a join to be as large as the product of both sides.
    nation = table("nation").select("n_nationkey", "n_name")
    starts = nation.toDF("s_nationkey", "start_station_id")
    ends = nation.toDF("c_nationkey", "end_station_id")
    suppliers = table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    customers = table("customer").select(
        F.col("c_custkey").alias("o_custkey"),
        "c_nationkey",
        F.when(F.col("c_mktsegment") != "BUILDING", 1).otherwise(2).alias("member_type_id"),
    )
    orders = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table("lineitem").join(suppliers, "l_suppkey").join(starts, "s_nationkey")
    bought = orders.join(customers, "o_custkey").join(ends, "c_nationkey")
    trips = lines.join(bought, "l_orderkey").select(
        "start_station_id",
        "end_station_id",
        _time_id().alias("start_time_id"),
        "member_type_id",
        (F.lit(1) + F.col("l_linenumber") % 2).alias("bike_type_id"),
        (F.col("l_quantity") * 2).alias("duracion_minutos"),
    )
    balance = lines.select(
        F.col("start_station_id").alias("station_id"),
        _time_id().alias("time_id"),
        (-F.col("l_quantity")).alias("balance_net"),
        F.when(F.col("l_returnflag") == "R", "DESABASTO").otherwise("EXCESO").alias("tipo_evento_balance"),
        (F.col("l_discount") >= 0.08).alias("flag_evento_critico"),
    )
    calendar = _calendar(spark, folder)
    tenth = (F.col("time_id") * 37 % 400).cast("double") / 10.0 - 5.0
    weather = calendar.select(
        "time_id",
        tenth.alias("temperature_2m"),
        (tenth + (F.col("time_id") % 7 - 3).cast("double") / 2.0).alias("apparent_temperature"),
        (F.lit(40.0) + (F.col("time_id") * 13 % 60).cast("double")).alias("relative_humidity_2m"),
    )
    # Member types and tariffs. Inline tables have a known size.
    members = spark.sql(
        "select * from values (1, 'casual'), (2, 'member') as t(member_type_id, member_casual)"
    )
    tariffs = spark.sql(
        "select * from values (1, 1, 30, 0.39D), (1, 2, 30, 0.26D), (2, 1, 45, 0.25D), (2, 2, 45, 0.17D)"
        " as t(member_type_id, bike_type_id, minutos_incluidos, tarifa_minuto_excedente)"
    )
    return {
        "trips": trips,
        "dim_time": calendar,
        "weather": weather,
        "dim_member_type": members,
        "dim_tarifa": tariffs,
        "balance_event": balance,
    }
