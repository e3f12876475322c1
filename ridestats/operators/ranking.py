"""Global positions from a distributed sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import stage


def sorted_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """``(column, code)``: 0-based rank of each distinct non-NULL value.

    The values are range-sorted over all tasks; a value's code is its place in
    its partition plus the sizes of the partitions before it. Only the
    partition sizes, never the values, meet in one task.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = stage(
        values.orderBy(column).select(
            column,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        ),
        f"codes-{column}",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(
        column, (F.col("_offset") + F.col("_place")).cast("int").alias(code)
    )
