import pandas as pd
import pytest
from star_frames import rows
from pyspark.sql import functions as F

from ridestats.functions.numeric import equal_width_bin, finite
from ridestats.functions.pricing import excess_revenue, theoretical_revenue
from ridestats.plans import marts, reports


def mart_of(spark, data):
    schema = (
        "start_station_id string, end_station_id string, hour int, month int, day_name string, "
        "member_casual string, temperature_2m double, duracion_minutos double, ingreso_min_excedente double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)


def test_kpis_count_null_revenue_as_not_paying(spark):
    mart = mart_of(spark, [
        {"start_station_id": "a", "ingreso_min_excedente": 4.0},
        {"start_station_id": "a", "ingreso_min_excedente": 0.0},
        {"start_station_id": None, "ingreso_min_excedente": None},
        {"start_station_id": "b", "ingreso_min_excedente": 2.0},
    ])
    assert reports.kpis(mart).first()[:] == (4, 6.0, 2.0, 2, 50.0)


def test_roll_up_drops_null_keys_and_sums_nothing_to_zero(spark):
    mart = mart_of(spark, [
        {"hour": 1, "ingreso_min_excedente": 4.0}, {"hour": 1, "ingreso_min_excedente": 2.0},
        {"hour": 2, "ingreso_min_excedente": None}, {"hour": None, "ingreso_min_excedente": 9.0},
    ])
    got = rows(reports.revenue_by(mart, "hour"), "hour", "total_revenue", "avg_revenue", "trip_count")
    assert got == [(1, 6.0, 3.0, 2), (2, 0.0, None, 0)]


def test_balance_has_stations_of_one_kind(spark):
    mart = mart_of(spark, [
        {"start_station_id": "a", "end_station_id": "b"}, {"start_station_id": "a", "end_station_id": "b"},
        {"start_station_id": "c", "end_station_id": None}, {"start_station_id": None, "end_station_id": "d"},
    ])
    got = rows(reports.station_balance(mart), "station_id", "departures", "arrivals", "balance", "abs_balance")
    assert got == [("a", 2, 0, -2, 2), ("b", 0, 2, 2, 2), ("c", 1, 0, -1, 1), ("d", 0, 1, 1, 1)]


def test_ties_go_to_the_smaller_station(spark):
    data = [{"start_station_id": f"s{i:02d}", "end_station_id": "hub"} for i in range(25)]
    balance = reports.station_balance(mart_of(spark, data))
    top = [r["station_id"] for r in reports.station_balance_top(balance).collect()]
    assert top == ["hub"] + [f"s{i:02d}" for i in range(19)]
    ends = reports.station_balance_extremes(balance).collect()
    assert [r["station_id"] for r in ends if r["side"] == "deficit"] == [f"s{i:02d}" for i in range(10)]
    assert [r["station_id"] for r in ends if r["side"] == "surplus"][:2] == ["hub", "s00"]


@pytest.mark.parametrize("value", [5.0, 0.0, -5.0])
def test_constant_temperature_is_one_middle_bin(spark, value):
    mart = mart_of(spark, [{"temperature_2m": value, "ingreso_min_excedente": 1.0}] * 3)
    assert [(r["temp_bin"], r["trip_count"]) for r in reports.weather_impact(mart).collect()] == [(4, 3)]
    assert pd.cut(pd.Series([value] * 3), bins=10, labels=False).tolist() == [4, 4, 4]


def test_bins_are_right_closed_like_pandas(spark):
    values = [i / 10 for i in range(0, 101)] + [0.05, 9.99]
    df = spark.createDataFrame([(v,) for v in values], "t double")
    binned = df.withColumn("b", equal_width_bin(F.col("t"), F.lit(0.0), F.lit(10.0)))
    got = {r["t"]: r["b"] for r in binned.collect()}
    want = dict(zip(values, pd.cut(pd.Series(values), bins=10, labels=False)))
    assert got == want


def test_weather_drops_missing_and_averages_over_trips(spark):
    mart = mart_of(spark, [
        {"temperature_2m": 0.0, "ingreso_min_excedente": 1.0, "duracion_minutos": 10.0},
        {"temperature_2m": 0.0, "ingreso_min_excedente": None, "duracion_minutos": 20.0},
        {"temperature_2m": 0.5, "ingreso_min_excedente": 3.0, "duracion_minutos": None},
        {"temperature_2m": 10.0, "ingreso_min_excedente": 5.0, "duracion_minutos": 40.0},
        {"temperature_2m": None, "ingreso_min_excedente": 7.0, "duracion_minutos": 50.0},
    ])
    got = {r["temp_bin"]: r for r in reports.weather_impact(mart).collect()}
    assert set(got) == {0, 9}
    assert (got[0]["avg_revenue"], got[0]["total_revenue"], got[0]["trip_count"]) == (2.0, 4.0, 2)
    assert got[0]["avg_duration"] == 15.0 and got[0]["avg_temperature"] == pytest.approx(0.5 / 3)
    assert reports.weather_chart(reports.weather_impact(mart)).count() == 2


def test_weather_reads_text_temperatures(spark):
    text = mart_of(spark, [{"ingreso_min_excedente": 1.0}] * 3).drop("temperature_2m")
    data = spark.createDataFrame([("12.5", 1.0, 1.0), ("x", 1.0, 1.0), (None, 1.0, 1.0)], "temperature_2m string, ingreso_min_excedente double, duracion_minutos double")
    assert text.count() == 3
    assert [(r["temp_bin"], r["trip_count"]) for r in reports.weather_impact(data).collect()] == [(4, 1)]


def test_user_distribution_title_case(star):
    assert rows(reports.user_distribution(marts.trip_mart(star)), "name", "value") == [("Casual", 5), ("Member", 1)]


def test_histogram_covers_all_values(spark):
    values = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 25, 49.999, 50]], "p double")
    got = reports.value_histogram(values, "p").collect()
    assert {r["bin"]: r["frequency"] for r in got} == {0: 2, 1: 1, 25: 1, 49: 2}
    assert got[0]["mean_value"] == pytest.approx(125.999 / 6)


def test_histogram_of_a_constant(spark):
    values = spark.createDataFrame([(2.0,)] * 4, "p double")
    assert [(r["bin"], r["frequency"]) for r in reports.value_histogram(values, "p").collect()] == [(0, 4)]


def test_prices(spark):
    df = spark.createDataFrame([(40.0,), (30.0,), (10.0,), (None,)], "d double")
    got = df.select(
        excess_revenue(F.col("d"), F.lit(30), F.lit(0.5)).alias("e"), theoretical_revenue(F.col("d")).alias("t")
    ).collect()
    assert [r["e"] for r in got] == [5.0, 0.0, 0.0, 0.0]
    assert [r["t"] for r in got] == [pytest.approx(3.9), 0.0, 0.0, 0.0]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [1.0, None, None, None, None]


def test_numbers_that_are_not_finite_count_for_nothing(spark):
    odd = [float("inf"), float("-inf"), float("nan"), None]
    values = spark.createDataFrame([(float(i),) for i in range(100)] + [(v,) for v in odd], "p double")
    bars = reports.value_histogram(values, "p").collect()
    assert sum(r["frequency"] for r in bars) == 100 and {r["mean_value"] for r in bars} == {49.5} and len(bars) == 50
    mart = values.selectExpr("p as temperature_2m", "1.0D as ingreso_min_excedente", "2.0D as duracion_minutos")
    impact = reports.weather_impact(mart).collect()
    assert len(impact) == 10 and sum(r["trip_count"] for r in impact) == 100
    # No shuffle is keyed by a value: only the bins are.
    plan = reports.value_histogram(values, "p")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin" in plan and "hashpartitioning(v" not in plan and "hashpartitioning(p" not in plan


def test_title_case_starts_a_word_after_any_non_letter(spark):
    names = ["casual", "day_pass", "annual-plus", "2nd CLASS", "ÉLITE d'or", ""]
    mart = spark.createDataFrame([(n,) for n in names], "member_casual string")
    assert {r["name"] for r in reports.user_distribution(mart).collect()} == {n.title() for n in names}
