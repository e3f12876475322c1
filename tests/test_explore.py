import pytest
from star_frames import rows

from ridestats.plans import explore, marts
from ridestats.plans.explore import Filters

COLUMNS = (
    "start_station_id string, end_station_id string, hour int, day_name string, is_weekend boolean, month int, "
    "temperature_2m double, relative_humidity_2m double, bike_type_id int, duracion_minutos double, "
    "member_casual string, ingreso_min_excedente double, minutos_incluidos int, tarifa_minuto_excedente double"
)


def mart_of(spark, stations, revenue=None, member="casual", month=1):
    data = [
        (s, "end", i % 24, "Monday", False, month, 1.25, 50.0, 1, 10.0 + i, member,
         revenue[i] if revenue else float(i), 30, 0.39)
        for i, s in enumerate(stations)
    ]
    return spark.createDataFrame(data, COLUMNS)


def test_station_filter_is_a_case_insensitive_regex(spark):
    mart = mart_of(spark, ["a.b", "axb", None, "cd"])
    got = rows(explore.filtered(mart, Filters(station_filter="A.B")), "start_station_id")
    assert got == [("a.b",), ("axb",)]


def test_no_filter_and_month_zero_keep_all(spark):
    mart = mart_of(spark, ["a", "b", None])
    assert explore.filtered(mart, Filters()).count() == 3
    assert explore.filtered(mart, Filters(month_filter=0, station_filter="", member_type_filter="")).count() == 3
    assert explore.filtered(mart, Filters(month_filter=2)).count() == 0


def test_revenue_bounds_are_inclusive_and_drop_null(spark):
    mart = mart_of(spark, list("abcd"), revenue=[1.0, 2.0, None, 3.0])
    assert rows(explore.filtered(mart, Filters(min_revenue=2.0)), "start_station_id") == [("b",), ("d",)]
    assert rows(explore.filtered(mart, Filters(min_revenue=1.0, max_revenue=2.0)), "start_station_id") == [("a",), ("b",)]
    assert explore.filtered(mart, Filters(min_revenue=0.0)).count() == 3


def test_applied_filters_are_repeated():
    assert Filters(month_filter=3).applied() == {
        "station_filter": None, "member_type_filter": None, "month_filter": 3, "min_revenue": None, "max_revenue": None,
    }


@pytest.mark.parametrize("order,first", [("asc", 1.0), ("DESC", 3.0)])
def test_nulls_sort_last_both_ways(spark, order, first):
    mart = mart_of(spark, list("abc"), revenue=[None, 3.0, 1.0])
    got = [r["revenue"] for r in explore.page(mart, sort_by="INGRESO_MIN_EXCEDENTE", sort_order=order).collect()]
    assert got[0] == first and got[-1] is None


def test_pages(spark):
    mart = mart_of(spark, [f"s{i:02d}" for i in range(25)])
    sizes = [explore.page(mart, page=p).count() for p in (1, 3, 4)]
    assert sizes == [10, 5, 0]
    assert explore.summary(mart, limit=10).first()["total_pages"] == 3
    third = explore.page(mart, page=3).orderBy("id").collect()
    assert [r["id"] for r in third] == [f"s{i}_{i}" for i in range(20, 25)]
    assert third[0]["temperature"] in (1.2, 1.3) and third[0]["included_minutes"] == 30


def test_unknown_sort_column_is_ignored(spark):
    mart = mart_of(spark, list("cab"))
    assert {r["start_station_id"] for r in explore.page(mart, sort_by="nope").collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("limit,columns", [(10, ("start_station_id",)), (3, ("hour", "start_station_id")), (7, ())])
def test_a_walk_shows_every_row_once(spark, limit, columns):
    """Many rows per station, copies, NULL stations and revenues."""
    one = [(s, "end", h, "Monday", False, 1, 1.25, 50.0, 1, 10.0, m, r, 30, 0.39)
           for s in ("a", "b", None) for h in (1, 2) for m in ("casual", None) for r in (1.0, None, float("nan"))]
    mart = spark.createDataFrame(one + one[:5] * 4, COLUMNS).repartition(4)
    seen, after = [], None
    while True:
        page = explore.page_after(mart, after, limit=limit, columns=columns)
        got = page.select(*mart.columns).collect()
        seen += [repr(tuple(r)) for r in got]
        after = explore.cursor_of(page, after, columns)
        if after is None:
            break
        assert 0 < len(got) <= limit
    assert sorted(seen) == sorted(repr(tuple(r)) for r in mart.collect())


def test_accented_names_match_in_any_case(spark):
    mart = mart_of(spark, ["Ávila", "Avila", "MÓSTOLES"])
    assert rows(explore.filtered(mart, Filters(station_filter="ávila|móstoles")), "start_station_id") == [("MÓSTOLES",), ("Ávila",)]


def test_summary_of_nothing(spark):
    row = explore.summary(mart_of(spark, ["a"]), Filters(month_filter=9)).first()
    assert (row["total_records"], row["total_pages"], row["total_revenue"], row["avg_revenue"]) == (0, 0, 0.0, None)


def test_member_distribution_leaves_out_null(star):
    got = [tuple(r) for r in explore.member_distribution(marts.trip_mart(star)).collect()]
    assert got == [("casual", 5), ("member", 1)]


def test_column_profile(spark):
    mart = mart_of(spark, [f"s{i:02d}" for i in range(49)] + [None] * 30)
    got = {r["name"]: r for r in explore.column_profile(mart).collect()}
    assert got["start_station_id"]["unique_values"] == 49
    assert got["start_station_id"]["sample_values"] == [f"s{i:02d}" for i in range(10)]
    assert got["duracion_minutos"]["unique_values"] is None and got["duracion_minutos"]["sample_values"] == []
    assert got["is_weekend"]["type"] == "boolean" and got["is_weekend"]["sample_values"] == ["false"]
    fifty = {r["name"]: r for r in explore.column_profile(mart_of(spark, [f"s{i}" for i in range(50)])).collect()}
    assert fifty["start_station_id"]["unique_values"] is None
