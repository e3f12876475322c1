"""Result sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_result(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result as a distributed job; ``fmt`` is any Spark file format."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
