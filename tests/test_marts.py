import glob
import os

import pytest
from pyspark.sql import functions as F
from star_frames import BALANCE, TRIPS, WEATHER, make_star, rows

from ridestats.plans import marts
from ridestats.sources import load_star, register_star, scratch, scratch_dir, stage, validate_dims, write_result
from ridestats.sources.star import STAR


def test_trip_mart_joins_and_prices(star):
    got = rows(marts.trip_mart(star), "start_station_id", "member_casual", "duracion_minutos", "ingreso_min_excedente")
    want = [
        ("a", "casual", 40.0, pytest.approx(3.9)),
        ("a", "casual", None, 0.0),
        ("a", "casual", 30.0, 0.0),
        ("b", "member", 100.0, pytest.approx(13.75)),
        ("b", "casual", 50.0, pytest.approx(7.8)),
        (None, "casual", 60.0, pytest.approx(7.8)),
        ("c", None, 90.0, pytest.approx(45.0)),
    ]
    assert len(got) == len(want)
    for row in want:
        assert row in got


def test_mart_year_is_a_parameter(star):
    assert marts.trip_mart(star, year=2023).count() == 1
    assert marts.trip_mart(star, year=None).count() == 8


def test_two_weather_rows_multiply_trips_and_are_reported(spark):
    doubled = make_star(spark, weather=[*WEATHER, (1, 5.0, 5.0, 5.0)])
    assert marts.trip_mart(doubled).count() == 9
    found = {r["table_name"]: (r["duplicate_keys"], r["extra_rows"]) for r in validate_dims(doubled).collect()}
    assert found["weather"] == (1, 1) and found["dim_time"] == (0, 0)


def test_training_set_leaves_out_critical_shortages(star):
    got = rows(marts.training_set(star), "station_id", "time_id")
    # a@1 is short; the null station never matches; members are out.
    assert got == sorted([("a", 2), ("b", 3), (None, 3)], key=repr)


def test_training_set_without_shortages(spark):
    calm = make_star(spark, balance=[("a", 1, -1.0, "EXCESO", True)])
    assert marts.training_set(calm).count() == 5


def test_profile_keeps_null_station_and_applies_minimum(spark):
    trips = [("a", "b", 1, 1, 1, 30.0 + i) for i in range(5)] + [(None, "b", 1, 1, 1, 40.0)] * 5
    trips += [("b", "a", 1, 1, 1, 40.0)] * 4
    profile = marts.station_hour_profile(make_star(spark, trips=trips))
    got = {r["station_id"]: r for r in profile.collect()}
    assert set(got) == {"a", None}
    assert got["a"]["viajes_count"] == 5 and got["a"]["viajes_con_excedente"] == 4
    assert got["a"]["ingreso_maximo"] == pytest.approx(4 * 0.39)
    assert got["a"]["variabilidad_ingresos"] == pytest.approx(0.39 * 2.5**0.5)


def test_station_stats(star):
    got = {r["station_id"]: r for r in marts.station_stats(star).collect()}
    assert got["a"]["viajes_totales"] == 3 and got["a"]["duracion_promedio_estacion"] == 35.0
    assert got["a"]["prop_bike_type_1"] == pytest.approx(2 / 3)


def test_shortage_events_are_distinct_and_defaulted(star):
    got = {(r["station_id"], r["time_id"]): r for r in marts.shortage_events(star).collect()}
    assert set(got) == {("a", 1), ("z", 2), ("c", 3)}
    assert got["z", 2]["duracion_promedio_estacion"] == 35.0
    assert got["z", 2]["prop_bike_type_1"] == 0.7
    assert got["a", 1]["viajes_perdidos_estimados"] == 6.0
    assert got["z", 2]["viajes_perdidos_estimados"] == 1.0
    assert got["c", 3]["viajes_perdidos_estimados"] == 0.0
    assert all(r["minutos_incluidos"] == 30 for r in got.values())


def test_load_star_from_files_and_catalog(spark, star, tmp_path):
    for table, df in star.items():
        write_result(df.toDF(*[c.upper() for c in df.columns]), f"{tmp_path}/{table}")
    loaded = load_star(spark, str(tmp_path))
    assert {t: df.columns for t, df in loaded.items()} == {t: list(c) for t, c in STAR.items()}
    assert loaded["trips"].count() == len(TRIPS)
    for table in star:
        loaded[table].createOrReplaceTempView(f"v_{table}")
    named = load_star(spark, fmt="table", names={t: f"v_{t}" for t in star})
    assert marts.trip_mart(named).count() == 7


def test_load_star_turns_bad_measures_to_null_and_misses_loudly(spark, star, tmp_path):
    bad = spark.createDataFrame([(1, "12.5", "x", None)], "time_id int, temperature_2m string, apparent_temperature string, relative_humidity_2m string")
    for table, df in star.items():
        write_result(bad if table == "weather" else df, f"{tmp_path}/{table}")
    assert load_star(spark, str(tmp_path))["weather"].first()[:] == (1, 12.5, None, None)
    write_result(star["trips"].drop("bike_type_id"), f"{tmp_path}/trips", mode="overwrite")
    with pytest.raises(ValueError, match="bike_type_id"):
        load_star(spark, str(tmp_path))


def test_saved_mart_is_read_until_refreshed(spark, star, tmp_path):
    path = f"{tmp_path}/mart"
    assert marts.saved_mart(star, path).count() == 7
    fewer = make_star(spark, trips=TRIPS[:2], balance=BALANCE)
    assert marts.saved_mart(fewer, path).count() == 7
    assert marts.saved_mart(fewer, path, refresh=True).count() == 2


def test_free_sql_over_the_star(spark, star):
    register_star(star, {"trips": "my_trips"})
    assert spark.sql("select count(*) from my_trips join dim_time on start_time_id = time_id").first()[0] == 9


def hot_star(spark):
    """Half of the trips leave one station in one hour, which is also short there."""
    trips = [("a", "b", 1, 1, 1, 40.0 + i % 50) for i in range(4000)]
    trips += [(f"s{i % 40}", "a", 1 + i % 4, 1 + i % 2, 1 + i % 2, float(i % 90)) for i in range(4000)]
    balance = [("a", 1, -3.0, "DESABASTO", True)] * 500 + [(f"s{i}", 2, -2.0, "DESABASTO", True) for i in range(0, 40, 3)]
    return make_star(spark, trips=trips, balance=balance)


def test_joins_without_broadcast_and_with_a_hot_key_give_the_same(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    }

    def results():
        hot = hot_star(spark)
        return [
            sorted(map(tuple, df.collect()), key=repr)
            for df in (marts.training_set(hot), marts.trip_mart(hot), marts.shortage_events(hot))
        ]

    usual = results()
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        shuffled = results()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [len(r) for r in usual][:2] == [len(r) for r in shuffled][:2] and usual == shuffled
    assert len(usual[0]) > 0 and not any(r[0] == "a" for r in usual[0])


def test_stage_uses_the_configured_folder(spark):
    staged = stage(spark.range(3).toDF("n"), "unit")
    assert staged.count() == 3
    assert all(scratch_dir(spark).removeprefix("file:") in f for f in staged.inputFiles())


def test_saved_marts_of_two_years_and_months(spark, star, tmp_path):
    path = str(tmp_path / "marts")
    for year in (2024, 2023, None, 2024):
        saved, fresh = marts.saved_mart(star, path, year=year), marts.trip_mart(star, year=year)
        assert rows(saved, *marts.MART_COLUMNS) == rows(fresh, *marts.MART_COLUMNS)
    month = saved.where("month = 2")
    assert "PartitionFilters: [isnotnull(month" in month._jdf.queryExecution().executedPlan().toString()


def test_a_mart_whose_writing_broke_off_is_computed_again(spark, star, tmp_path):
    path = str(tmp_path / "mart")
    marts.trip_mart(star).limit(1).write.partitionBy("month").parquet(f"{path}/trips/span=2024")
    assert marts.saved_mart(star, path).count() == 7


def files_by_month(path):
    found = {}
    for file in glob.glob(f"{path}/trips/span=2024/*/*.parquet"):
        found.setdefault(os.path.basename(os.path.dirname(file)), set()).add(os.path.basename(file))
    return found


def test_a_refresh_writes_changed_months_only(spark, tmp_path):
    path = str(tmp_path / "mart")
    first = make_star(spark)
    mart, months = marts.refreshed_mart(first, path)
    assert months == [1, 2, 3] and rows(mart, *marts.MART_COLUMNS) == rows(marts.trip_mart(first), *marts.MART_COLUMNS)
    before = files_by_month(path)
    assert marts.refreshed_mart(make_star(spark, trips=TRIPS[::-1]), path)[1] == [] and files_by_month(path) == before

    def refreshed(want, **changed):
        star = make_star(spark, **changed)
        mart, months = marts.refreshed_mart(star, path)
        assert months == want and rows(mart, *marts.MART_COLUMNS) == rows(marts.trip_mart(star), *marts.MART_COLUMNS)

    more = [*TRIPS, ("a", "a", 2, 1, 1, 45.0)]  # a trip of February
    refreshed([2], trips=more)
    after = files_by_month(path)
    assert {m for m in before if before[m] != after[m]} == {"month=2"}
    refreshed([3], trips=more, weather=[w if w[0] != 4 else (4, 1.0, 2.0, 3.0) for w in WEATHER])  # weather of March
    refreshed([1, 2, 3], trips=more, tariffs=[(1, 1, 30, 0.5), (1, 2, 30, 0.26), (2, 1, 45, 0.25), (2, 2, 45, 0.17)])
    refreshed([1, 2, 3], trips=[t for t in more if t[2] != 4])  # March ends, tariffs are as before
    assert "month=3" not in files_by_month(path)


def test_a_refresh_that_broke_off_is_done_again(spark, tmp_path):
    path = str(tmp_path / "mart")
    marts.refreshed_mart(make_star(spark), path)
    star = make_star(spark, trips=TRIPS[:3])
    spark.createDataFrame([(1, 0, "x")], "month int, rows bigint, digest string").write.mode("overwrite").parquet(f"{path}/prints/span=2024")
    mart, months = marts.refreshed_mart(star, path)
    assert months == [1, 2] and mart.where("month < 3").count() == 3


@pytest.mark.parametrize("again", [False, True])
def test_mart_is_written_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path, again):
    """One shuffle partition and large files do not make one large task; small months stay in one file."""
    n, some = 40_000, make_star(spark)["trips"]
    star = {name: stage(table, "dim") for name, table in make_star(spark).items()}  # of known size
    star["trips"] = spark.range(n, numPartitions=4).selectExpr(
        "concat('s', id % 5) start_station_id", "concat('e', id) end_station_id", "1 + id % 50 div 49 start_time_id",
        "1 member_type_id", "1 bike_type_id", "double(xxhash64(id) % 10000) duracion_minutos").select(*[F.col(c).cast(some.schema[c].dataType) for c in some.columns])

    def written(name):
        if again:  # months are written by the refresh, not the first time
            marts.refreshed_mart(make_star(spark), f"{tmp_path}/{name}")
        mart = (marts.refreshed_mart(star, f"{tmp_path}/{name}")[0] if again else marts.saved_mart(star, f"{tmp_path}/{name}"))
        assert mart.count() == n and mart.select(F.sum("duracion_minutos")).first() == star["trips"].select(F.sum("duracion_minutos")).first()
        files = mart.groupBy("month", F.input_file_name()).count().collect()
        return {m: sorted(r["count"] for r in files if r["month"] == m) for m in (1, 2)}

    before = {k: spark.conf.get(k, None) for k in KEYS}
    star["trips"] = star["trips"].repartition(16)
    assert written("whole") == {1: [n - n // 50], 2: [n // 50]}
    monkeypatch.setattr(scratch, "TASK_BYTES", 64 << 10)
    found = written("parts")
    assert len(found[1]) > 4 and max(found[1]) < n / 4 and len(found[2]) == 1
    assert {k: spark.conf.get(k, None) for k in KEYS} == before


KEYS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")
