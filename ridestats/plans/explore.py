"""Filtered, sorted and paged browsing of the trip mart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import sum0

REVENUE = "ingreso_min_excedente"
_FEW_VALUES = 50
_CANDIDATE = 100  # approximate distinct count up to which values are gathered
_SAMPLE = 10


@dataclass(frozen=True)
class Filters:
    """Optional filters; one that is unset (or month 0, or empty text) does nothing."""

    station_filter: str | None = None
    member_type_filter: str | None = None
    month_filter: int | None = None
    min_revenue: float | None = None
    max_revenue: float | None = None

    def predicates(self) -> list[Column]:
        present: list[Column] = []
        if self.station_filter:
            present.append(_matches("start_station_id", self.station_filter))
        if self.member_type_filter:
            present.append(_matches("member_casual", self.member_type_filter))
        if self.month_filter:
            present.append(F.col("month") == self.month_filter)
        if self.min_revenue is not None:
            present.append(F.col(REVENUE) >= F.lit(self.min_revenue))
        if self.max_revenue is not None:
            present.append(F.col(REVENUE) <= F.lit(self.max_revenue))
        return present

    def applied(self) -> dict[str, object]:
        """The filters as given, for an answer to repeat."""
        return asdict(self)


def _matches(column: str, pattern: str) -> Column:
    """Case-insensitive regular-expression search; NULL does not match."""
    return F.coalesce(F.col(column).cast("string").rlike(f"(?iu){pattern}"), F.lit(False))


def filtered(mart: DataFrame, filters: Filters) -> DataFrame:
    present = filters.predicates()
    return mart.where(reduce(and_, present)) if present else mart


def _order(df: DataFrame, sort_by: str, ascending: bool) -> list[Column]:
    """Chosen column with NULLs last either way, then all columns: a total order."""
    known = {c.lower(): c for c in df.columns}
    chosen = known.get(sort_by.lower())
    rest = [F.asc_nulls_last(c) for c in df.columns if c != chosen]
    if chosen is None:
        return rest
    return [F.asc_nulls_last(chosen) if ascending else F.desc_nulls_last(chosen), *rest]


def page(
    mart: DataFrame,
    filters: Filters = Filters(),
    page: int = 1,
    limit: int = 10,
    sort_by: str = "start_station_id",
    sort_order: str = "asc",
) -> DataFrame:
    """One 1-based page of records. An unknown sort column leaves the plain order."""
    ascending = sort_order.lower() == "asc"
    rows = filtered(mart, filters)
    order = _order(rows, sort_by, ascending)
    start = (page - 1) * limit
    chosen = rows.orderBy(*order).offset(start).limit(limit)
    return _records(chosen, order, start)


@dataclass(frozen=True)
class Cursor:
    """Where a walk over all rows stands: the last row shown, and how many equal ones were."""

    values: tuple[object, ...]
    copies: int


def _walk_order(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    return [*columns, *[c for c in rows.columns if c not in columns]]


def page_after(
    mart: DataFrame,
    after: Cursor | None = None,
    filters: Filters = Filters(),
    limit: int = 10,
    columns: Sequence[str] = ("start_station_id",),
) -> DataFrame:
    """The ``limit`` rows that follow the cursor; the first ones without a cursor.

    For deep pages: the cost does not grow with the page number. Rows come by
    ``columns`` and then all other columns, ascending with NULLs last, which is a
    total order up to rows that are equal throughout; of those the cursor counts
    how many were shown. A walk shows every row once.
    """
    rows = filtered(mart, filters)
    order = _walk_order(rows, columns)
    rows = rows.select(*order)
    by = [F.asc_nulls_last(c) for c in order]
    if after is None:
        return rows.orderBy(*by).limit(limit)
    beyond, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, after.values, strict=True):
        column, at = F.col(name), F.lit(value)
        if value is not None:  # NULLs come last: nothing follows them
            beyond = beyond | (equal & (column.isNull() | (column > at)))
        equal = equal & column.eqNullSafe(at)
    left = max(0, rows.where(equal).count() - after.copies)
    again = rows.sparkSession.createDataFrame([after.values] * min(left, limit), rows.schema)
    if left >= limit:
        return again
    return again.unionByName(rows.where(beyond).orderBy(*by).limit(limit - left))


def cursor_of(
    page: DataFrame, before: Cursor | None = None, columns: Sequence[str] = ("start_station_id",)
) -> Cursor | None:
    """The cursor behind a page that followed ``before``; None behind an empty page."""
    order = _walk_order(page, columns)
    last = page.select(*order).orderBy(*[F.desc_nulls_first(c) for c in order]).first()
    if last is None:
        return None
    equal = reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order, last)])
    copies = page.where(equal).count()
    # NaN is equal to itself here, as in Spark.
    same = before is not None and all(a == b or (a != a and b != b) for a, b in zip(before.values, last))
    return Cursor(tuple(last), copies + (before.copies if same else 0))


def _records(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    # The window sees one page only.
    position = F.row_number().over(Window.orderBy(*order)) - 1 + F.lit(start)

    def rounded(name: str, digits: int) -> Column:
        return F.round(F.col(name).cast("double"), digits)

    return rows.select(
        F.concat_ws("_", "start_station_id", position.cast("string")).alias("id"),
        F.col("start_station_id").cast("string").alias("start_station_id"),
        F.col("end_station_id").cast("string").alias("end_station_id"),
        F.col("hour").cast("int").alias("hour"),
        F.col("day_name").cast("string").alias("day_name"),
        F.col("is_weekend").cast("boolean").alias("is_weekend"),
        F.col("month").cast("int").alias("month"),
        rounded("temperature_2m", 1).alias("temperature"),
        rounded("relative_humidity_2m", 1).alias("humidity"),
        F.col("bike_type_id").cast("int").alias("bike_type"),
        rounded("duracion_minutos", 1).alias("duration"),
        F.col("member_casual").cast("string").alias("member_type"),
        rounded(REVENUE, 2).alias("revenue"),
        F.col("minutos_incluidos").cast("int").alias("included_minutes"),
        rounded("tarifa_minuto_excedente", 2).alias("excess_rate"),
    )


def summary(mart: DataFrame, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
    """Totals of the filtered set and the number of pages it has."""
    return filtered(mart, filters).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("total_pages"),
        F.round(sum0(REVENUE), 2).alias("total_revenue"),
        F.round(F.avg(REVENUE), 2).alias("avg_revenue"),
        F.round(F.avg("duracion_minutos"), 1).alias("avg_duration"),
        F.count_distinct("start_station_id").alias("unique_stations"),
    )


def member_distribution(mart: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Filtered trips per member type, most frequent first."""
    return (
        filtered(mart, filters)
        .where(F.col("member_casual").isNotNull())
        .groupBy("member_casual")
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), "member_casual")
    )


def column_profile(mart: DataFrame) -> DataFrame:
    """Name, type and, below 50 distinct values, their number and the 10 smallest.

    A sketch pass picks the columns with few values; only their value sets are
    gathered, in one further pass.
    """
    spark, types = mart.sparkSession, dict(mart.dtypes)
    rough = mart.agg(*[F.approx_count_distinct(c).alias(c) for c in mart.columns]).first()
    few = [c for c in mart.columns if rough[c] <= _CANDIDATE]
    sets: dict[str, tuple[int, list[str]]] = {}
    if few:
        exact = mart.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).select(
            *[
                F.struct(
                    F.size(c).alias("n"),
                    F.slice(F.col(c), 1, _SAMPLE).cast("array<string>").alias("sample"),
                ).alias(c)
                for c in few
            ]
        ).first()
        sets = {c: (exact[c]["n"], exact[c]["sample"]) for c in few}

    def describe(c: str) -> tuple[str, str, int | None, list[str]]:
        n, sample = sets.get(c, (_FEW_VALUES, []))
        return (c, types[c], n, sample) if n < _FEW_VALUES else (c, types[c], None, [])

    return spark.createDataFrame(
        [describe(c) for c in mart.columns],
        "name string, type string, unique_values int, sample_values array<string>",
    )
