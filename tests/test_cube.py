import pytest
from pyspark.sql import functions as F

from ridestats.plans import cube, explore, reports
from star_frames import rows
from test_explore import COLUMNS

KPIS = ["total_viajes", "ingresos_totales", "ingreso_promedio", "estaciones_activas", "viajes_con_ingresos"]


def mart_of(spark, n):
    data = [(None if i % 13 == 0 else f"s{i * i % 997}", "end", i % 24, "Monday", False, 1 + i % 3, 1.25, 50.0, 1, 10.0,
             [None, "casual", "member"][i % 3], [None, 0.0, 1.5, 2.25][i % 4], 30, 0.39) for i in range(n)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize("stations", [997, 70_000])
def test_figures_of_any_filter_equal_those_of_the_trips(spark, stations):
    mart = mart_of(spark, 3000)
    if stations > 997:  # more than one bitmap
        many = spark.range(stations).select(F.lit(1).alias("month"), F.concat(F.lit("t"), F.col("id")).alias("start_station_id"))
        mart = mart.limit(1).drop("start_station_id", "month").crossJoin(many).select(*mart.columns).unionByName(mart)
    kept = cube.kpi_cube(mart)
    for where in (None, F.col("month") == 2, F.col("hour").between(7, 9) & (F.col("member_casual") == "casual"), F.col("month") == 9):
        want = reports.kpis(mart if where is None else mart.where(where)).first()
        got = cube.kpis(kept, where).first()
        assert [got[k] for k in KPIS] == [pytest.approx(want[k]) if want[k] is not None else None for k in KPIS]
    by_month = {r["month"]: [r[k] for k in KPIS] for r in cube.kpis(kept, by=("month",)).collect()}
    for month in (1, 2, 3):
        want = reports.kpis(mart.where(F.col("month") == month)).first()
        assert by_month[month] == [pytest.approx(want[k]) for k in KPIS]


def test_the_cube_is_small_and_stations_are_not_shuffled(spark):
    kept = cube.kpi_cube(mart_of(spark, 3000))
    assert kept.count() <= 3 * 24 * 3 * 2
    plan = cube.kpis(kept, F.col("month") == 2)._jdf.queryExecution().toString()
    assert "start_station_id" not in plan
    assert cube.kpi_cube(mart_of(spark, 1).limit(0)).count() == 0
    summary = explore.summary(mart_of(spark, 300)).first()
    assert cube.kpis(cube.kpi_cube(mart_of(spark, 300))).first()["estaciones_activas"] == summary["unique_stations"]
    assert rows(cube.kpis(kept.limit(0)), *KPIS) == [(0, 0.0, None, 0, None)]
