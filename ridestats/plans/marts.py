"""Analysis tables built from the star.

No join here carries a broadcast hint: dimension tables come from files or the
catalog, so Catalyst knows their size and broadcasts those that are small; the
others become sort-merge joins whose hot keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.pricing import INCLUDED_MINUTES, excess_revenue
from ..sources.scratch import delete_folder, small_tasks, stage

Star = Mapping[str, DataFrame]

# Filters and defaults of the analyses.
YEAR = 2024
CASUAL = "casual"
SHORTAGE = "DESABASTO"
MIN_GROUP = 5
DEFAULT_DURATION = 35.0
DEFAULT_BIKE_SHARE = 0.7
LOST_SHARE = 0.6
MONTH_PARTITIONS = 24  # into which months are dealt before large ones are split

MART_COLUMNS = [
    "start_station_id", "end_station_id", "hour", "day_name", "is_weekend", "month",
    "temperature_2m", "relative_humidity_2m", "bike_type_id", "duracion_minutos",
    "member_casual", "ingreso_min_excedente", "minutos_incluidos", "tarifa_minuto_excedente",
]


def _timed(facts: DataFrame, time_key: str, star: Star, year: int | None) -> DataFrame:
    """Facts with the calendar columns of their time id."""
    calendar = star["dim_time"]
    if year is not None:
        calendar = calendar.where(F.col("year") == year)
    return facts.join(calendar.withColumnRenamed("time_id", time_key), time_key)


def _members(trips: DataFrame, star: Star, member: str | None) -> DataFrame:
    labels = star["dim_member_type"]
    if member is not None:
        labels = labels.where(F.col("member_casual") == member)
    return trips.join(labels, "member_type_id")


def _revenue() -> Column:
    return excess_revenue(
        F.col("duracion_minutos"), F.col("minutos_incluidos"), F.col("tarifa_minuto_excedente")
    )


def _priced(star: Star, trips: DataFrame, year: int | None, member: str | None) -> DataFrame:
    """Trips with calendar, weather, member label, tariff and revenue."""
    timed = _timed(trips, "start_time_id", star, year)
    weathered = timed.join(star["weather"].withColumnRenamed("time_id", "start_time_id"), "start_time_id")
    tariffed = _members(weathered, star, member).join(star["dim_tarifa"], ["member_type_id", "bike_type_id"])
    return tariffed.withColumn("ingreso_min_excedente", _revenue())


def trip_mart(star: Star, year: int | None = YEAR) -> DataFrame:
    """One row per priced trip of the year: the base of all reports."""
    return _priced(star, star["trips"], year, None).select(*MART_COLUMNS)


def saved_mart(star: Star, path: str, refresh: bool = False, year: int | None = YEAR) -> DataFrame:
    """The trip mart of a year kept as a table by month: computed on first use or ``refresh``.

    Each year (or all years, ``None``) has a folder of its own below ``path``. A mark
    is written last, so a table whose writing broke off is computed again.
    """
    spark = star["trips"].sparkSession
    name = "all" if year is None else str(year)
    table, mark = f"{path}/trips/span={name}", f"{path}/marks/span={name}"
    mart = trip_mart(star, year)
    if refresh or not table_exists(spark, mark, "id bigint"):
        _write_months(mart, table)
        spark.range(1).write.mode("overwrite").parquet(mark)
    return spark.read.schema(mart.schema).parquet(table).select(*MART_COLUMNS)


def _write_months(mart: DataFrame, table: str, **options: str) -> None:
    """Write the rows in folders by month.

    The joins and the writers' sort run in stages of their own, in tasks of bounded size;
    a month is in few files, split where it is large.
    """
    with small_tasks(mart.sparkSession):
        by_month = mart.hint("rebalance", MONTH_PARTITIONS, "month")
        by_month.write.mode("overwrite").options(**options).partitionBy("month").parquet(table)


def source_months(star: Star, year: int | None = YEAR) -> DataFrame:
    """(month, rows, digest) of what the mart of each month is computed from.

    The digest is a sum of row hashes, so order and layout of the sources do not matter.
    Trips and weather count for the months of their time ids; tariffs, labels and calendar
    columns count by the rows that would be joined.
    """
    timed = _timed(star["trips"], "start_time_id", star, year)
    own = timed.select("month", F.xxhash64(*sorted(timed.columns)).alias("h"), F.lit(1).alias("trip"))
    calendar = star["dim_time"] if year is None else star["dim_time"].where(F.col("year") == year)
    weather = star["weather"].join(calendar.select("time_id", "month"), "time_id")
    weathered = weather.select("month", F.xxhash64(F.lit("weather"), *sorted(c for c in weather.columns if c != "month")).alias("h"), F.lit(0).alias("trip"))
    sums = own.unionByName(weathered).groupBy("month").agg(
        F.sum("trip").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest")).where("rows > 0")

    def whole(table: str) -> Column:
        rows = star[table]
        return rows.agg(F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).scalar()

    shared = F.xxhash64(whole("dim_tarifa"), whole("dim_member_type"))  # small tables that all months use
    return sums.select("month", "rows", F.concat_ws("/", F.col("digest").cast("string"), shared.cast("string")).alias("digest"))


def refreshed_mart(star: Star, path: str, year: int | None = YEAR) -> tuple[DataFrame, list[int | None]]:
    """The saved mart brought up to date, and the months that were written again.

    Fingerprints of the sources by month, kept beside the table, tell which months changed;
    only these are computed, and replace their folders. Months without trips any more are
    emptied. The fingerprints are written last: a refresh that broke off is done again.
    """
    spark = star["trips"].sparkSession
    name = "all" if year is None else str(year)
    table, mark, prints = (f"{path}/{kind}/span={name}" for kind in ("trips", "marks", "prints"))
    now = stage(source_months(star, year), "months")
    schema = "month int, rows bigint, digest string"
    if not table_exists(spark, mark, "id bigint") or not table_exists(spark, prints, schema):
        months = [r["month"] for r in now.select("month").collect()]  # twelve a year
        mart = saved_mart(star, path, refresh=True, year=year)
    else:
        before = spark.read.schema(schema).parquet(prints)
        compared = now.alias("n").join(before.alias("b"), F.col("n.month").eqNullSafe(F.col("b.month")), "full_outer")
        same = F.coalesce(F.col("n.digest") == F.col("b.digest"), F.lit(False)) & (F.col("n.rows") == F.col("b.rows"))
        changed = compared.where(~F.coalesce(same, F.lit(False))).select(
            F.coalesce("n.month", "b.month").alias("month"), F.col("n.digest").isNull().alias("gone")).collect()
        months, mart = [r["month"] for r in changed], trip_mart(star, year)
        if months:
            some = F.col("month").isin([m for m in months if m is not None])
            some = some | F.col("month").isNull() if None in months else some
            _write_months(mart.where(some), table, partitionOverwriteMode="dynamic")
            for r in changed:
                if r["gone"]:
                    delete_folder(spark, f"{table}/month={'__HIVE_DEFAULT_PARTITION__' if r['month'] is None else r['month']}")
        mart = spark.read.schema(mart.schema).parquet(table).select(*MART_COLUMNS)
    now.coalesce(1).write.mode("overwrite").parquet(prints)
    return mart, sorted(months, key=lambda m: (m is None, m or 0))


def table_exists(spark: SparkSession, path: str, schema: str) -> bool:
    """Whether there is a table with rows at the path."""
    try:
        return not spark.read.schema(schema).parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def trip_revenue(star: Star) -> DataFrame:
    """Every trip with its tariff and the revenue from excess minutes."""
    priced = star["trips"].join(star["dim_tarifa"], ["member_type_id", "bike_type_id"])
    return priced.select(
        "start_station_id", "start_time_id", "member_type_id", "bike_type_id", "duracion_minutos",
        "minutos_incluidos", "tarifa_minuto_excedente", _revenue().alias("ingreso_min_excedente"),
    )


def _critical_shortages(star: Star) -> DataFrame:
    return star["balance_event"].where(
        (F.col("tipo_evento_balance") == SHORTAGE) & F.col("flag_evento_critico")
    )


def training_set(star: Star, year: int | None = YEAR, member: str | None = CASUAL) -> DataFrame:
    """Priced trips outside critical shortages of their start station.

    The shortage moments of the year are written first, so that their size is
    known: few of them are broadcast and the trips stay where they are; many
    make a sort-merge anti join.
    """
    moments = _timed(_critical_shortages(star), "time_id", star, year).select(
        F.col("station_id").alias("start_station_id"), F.col("time_id").alias("start_time_id")
    )
    shortage = stage(moments.distinct(), "shortages")
    calm = star["trips"].join(shortage, ["start_station_id", "start_time_id"], "left_anti")
    return _priced(star, calm, year, member).select(
        F.col("start_station_id").alias("station_id"), F.col("start_time_id").alias("time_id"),
        "hour", "day_name", "is_weekend", "month",
        "temperature_2m", "apparent_temperature", "relative_humidity_2m",
        "bike_type_id", "duracion_minutos", "minutos_incluidos", "tarifa_minuto_excedente",
        "ingreso_min_excedente",
    )


def station_hour_profile(
    star: Star,
    year: int | None = YEAR,
    member: str | None = CASUAL,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Activity of each station, hour, weekend flag and month, in groups of ``min_group`` up."""
    revenue = F.col("ingreso_min_excedente")
    groups = (
        _priced(star, star["trips"], year, member)
        .groupBy(F.col("start_station_id").alias("station_id"), "hour", "is_weekend", "month")
        .agg(
            F.count(F.lit(1)).alias("viajes_count"),
            F.avg(revenue).alias("ingreso_promedio"),
            F.sum(revenue).alias("ingreso_total"),
            F.avg("duracion_minutos").alias("duracion_promedio"),
            F.avg("temperature_2m").alias("temperatura_promedio"),
            F.stddev_samp(revenue).alias("variabilidad_ingresos"),
            F.max(revenue).alias("ingreso_maximo"),
            F.count_if(revenue > 0).alias("viajes_con_excedente"),
        )
    )
    return groups.where(F.col("viajes_count") >= min_group)


def station_stats(star: Star, year: int | None = YEAR, member: str | None = CASUAL) -> DataFrame:
    """Ride history per start station."""
    rides = _members(_timed(star["trips"], "start_time_id", star, year), star, member)
    return rides.groupBy(F.col("start_station_id").alias("station_id")).agg(
        F.avg("duracion_minutos").alias("duracion_promedio_estacion"),
        F.count(F.lit(1)).alias("viajes_totales"),
        F.avg(F.when(F.col("bike_type_id") == 1, 1.0).otherwise(0.0)).alias("prop_bike_type_1"),
    )


def shortage_events(star: Star, year: int | None = YEAR, member: str | None = CASUAL) -> DataFrame:
    """Critical shortages with calendar, weather, station history and lost trips."""
    events = (
        _timed(_critical_shortages(star), "time_id", star, year)
        .join(star["weather"], "time_id")
        .select(
            "station_id", "time_id", "balance_net", "hour", "day_name", "is_weekend", "month",
            "temperature_2m", "apparent_temperature", "relative_humidity_2m",
        )
        .distinct()
    )
    history = station_stats(star, year, member).drop("viajes_totales")
    duration = F.coalesce("duracion_promedio_estacion", F.lit(DEFAULT_DURATION))
    bike_share = F.coalesce("prop_bike_type_1", F.lit(DEFAULT_BIKE_SHARE))
    return (
        events.join(history, "station_id", "left")
        .withColumn("duracion_promedio_estacion", duration)
        .withColumn("prop_bike_type_1", bike_share)
        .withColumn("minutos_incluidos", F.lit(INCLUDED_MINUTES))
        .withColumn("viajes_perdidos_estimados", F.round(F.abs("balance_net") * F.lit(LOST_SHARE)))
    )
