"""Row multiplication that never loads one task with one row's copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 100_000


def repeat_rows(df: DataFrame, times: Column, ordinal: str, chunk: int = CHUNK) -> DataFrame:
    """Each row ``times`` times with a 1-based ``ordinal``; none when ``times`` < 1.

    A row with a large count is first cut into chunks which are spread over the
    tasks, then each chunk is expanded.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.withColumn("_times", times.cast("bigint")).where(F.col("_times") > 0)
    chunks = counted.withColumn(
        "_chunk",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / F.lit(chunk)))),
    ).repartition(tasks)
    start = F.col("_chunk") * F.lit(chunk)
    return chunks.withColumn(
        ordinal,
        F.explode(F.sequence(start + 1, F.least(F.col("_times"), start + F.lit(chunk)))),
    ).drop("_times", "_chunk")
