"""Headline figures kept by month, hour and member type, and added up for any filter on them.

Sums add up; distinct stations do not, so each cell keeps them as bitmaps over station
codes: a filter unites the bitmaps of the cells it leaves, exactly, and no station id is
shuffled again. Codes run through a bitmap of 32,768 stations after the other, and a trip
counts in the row of its station's bitmap, so sums are additive over those rows too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import sorted_codes
from ..sources.scratch import stage
from .reports import REVENUE, STATION

CELL = ("month", "hour", "member_casual")


def kpi_cube(mart: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell columns, bucket, trips, revenue, valued, paying, stations): a row per cell and bitmap, written once.

    ``valued`` trips have a revenue, ``paying`` ones a positive one. Trips without a start
    station stand in rows with a NULL bucket.
    """
    codes = stage(sorted_codes(mart, STATION, "code"), "cube-codes")
    coded = mart.join(codes, STATION, "left").select(*cell, REVENUE, (F.col("code") + 1).cast("long").alias("code"))
    placed = coded.withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("bit", F.bitmap_bit_position("code"))
    return stage(
        placed.groupBy(*cell, "bucket").agg(
            F.count(F.lit(1)).alias("trips"), F.coalesce(F.sum(REVENUE), F.lit(0.0)).alias("revenue"), F.count(REVENUE).alias("valued"),
            F.count_if(F.col(REVENUE) > 0).alias("paying"), F.expr("bitmap_construct_agg(bit) filter (where bit is not null)").alias("stations"),
        ),
        "kpi-cube",
    )


def kpis(cube: DataFrame, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The figures of :func:`ridestats.plans.reports.kpis` for a condition on the cells, for each value of ``by``."""
    cells = cube if where is None else cube.where(where)
    united = cells.groupBy(*by, "bucket").agg(
        *[F.sum(c).alias(c) for c in ("trips", "revenue", "valued", "paying")], F.bitmap_or_agg("stations").alias("stations")
    )
    distinct = F.when(F.col("bucket").isNotNull(), F.bitmap_count("stations")).otherwise(0)
    return united.groupBy(*by).agg(
        F.coalesce(F.sum("trips"), F.lit(0)).alias("total_viajes"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("ingresos_totales"),
        F.try_divide(F.sum("revenue"), F.sum("valued").cast("double")).alias("ingreso_promedio"),
        F.coalesce(F.sum(distinct), F.lit(0)).cast("long").alias("estaciones_activas"),
        (F.try_divide(F.sum("paying").cast("double"), F.sum("trips").cast("double")) * 100).alias("viajes_con_ingresos"),
    )
