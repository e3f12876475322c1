"""A small star made by hand, and what tests of several modules share."""

from __future__ import annotations

from ridestats.sources import STAR


def frame(spark, table, rows):
    schema = ", ".join(f"{c} {t}" for c, t in STAR[table].items())
    return spark.createDataFrame(rows, schema)


# Time ids 1..4: 2024 weekday and weekend hours; 9 is another year.
TIMES = [
    (1, 7, "Monday", False, 1, 2024),
    (2, 12, "Saturday", True, 2, 2024),
    (3, 22, "Friday", False, 2, 2024),
    (4, 0, "Sunday", True, 3, 2024),
    (9, 7, "Monday", False, 1, 2023),
]
WEATHER = [(1, 10.0, 11.0, 80.0), (2, 20.0, 21.5, 40.0), (3, 30.0, 29.0, 71.0), (4, None, None, None), (9, 1.0, 1.0, 1.0)]
TARIFFS = [(1, 1, 30, 0.39), (1, 2, 30, 0.26), (2, 1, 45, 0.25), (2, 2, 45, 0.17)]
TRIPS = [
    ("a", "b", 1, 1, 1, 40.0),
    ("a", "b", 1, 1, 1, None),
    ("a", "c", 2, 1, 2, 30.0),
    ("b", "a", 2, 2, 1, 100.0),
    ("b", None, 3, 1, 1, 50.0),
    (None, "a", 3, 1, 2, 60.0),
    ("c", "a", 4, 3, 1, 90.0),
    ("c", "a", 9, 1, 1, 90.0),
    ("c", "a", 1, 7, 1, 90.0),
]
BALANCE = [
    ("a", 1, -10.0, "DESABASTO", True),
    ("a", 1, -10.0, "DESABASTO", True),
    ("z", 2, -1.0, "DESABASTO", True),
    ("b", 2, -5.0, "EXCESO", True),
    ("b", 3, -5.0, "DESABASTO", False),
    ("b", 9, -5.0, "DESABASTO", True),
    ("c", 3, 0.4, "DESABASTO", True),
]


def make_star(spark, trips=TRIPS, weather=WEATHER, balance=BALANCE, tariffs=TARIFFS, members=None):
    return {
        "trips": frame(spark, "trips", trips),
        "dim_time": frame(spark, "dim_time", TIMES),
        "weather": frame(spark, "weather", weather),
        "dim_member_type": frame(spark, "dim_member_type", members or [(1, "casual"), (2, "member"), (3, None)]),
        "dim_tarifa": frame(spark, "dim_tarifa", [*tariffs, (3, 1, 0, 0.5)]),
        "balance_event": frame(spark, "balance_event", balance),
    }


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
