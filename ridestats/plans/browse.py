"""A sorted copy of the mart with an index, for walks over all its pages.

The copy is range-partitioned by the order of the walk and sorted, one file per range; its
index says how many rows the files before hold. A cursor is the position of a row, so the
next page opens the file that holds it, and further ones only while filters leave the page
short. A whole walk reads every file once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.scratch import small_tasks, stage
from .explore import Filters, filtered
from .marts import table_exists

FILE_ROWS = 1_000_000
_PART, _PLACE = "_part", "_place"  # the file, and the place in it
_PLACE_BITS = 33  # of the numbers that Spark gives rows of a task


@dataclass(frozen=True)
class SortedCopy:
    """The copy's rows with their file and place, and by file the rows in it and before it."""

    rows: DataFrame
    files: tuple[tuple[int, int, int], ...]  # file, rows, rows before; one entry per FILE_ROWS rows
    columns: tuple[str, ...]

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.files)


@dataclass(frozen=True)
class Page:
    """Rows of a page, where the next one starts (None: nothing follows), and the files opened for it."""

    rows: DataFrame
    next: int | None
    opened: tuple[int, ...]


def sorted_copy(
    mart: DataFrame, path: str, columns: Sequence[str] = ("start_station_id",), file_rows: int = FILE_ROWS, refresh: bool = False
) -> SortedCopy:
    """The copy kept at ``path``, written on first use or ``refresh``.

    Rows come by ``columns`` and then all other columns, ascending with NULLs last. Rows
    that are equal throughout may lie in several files. The index is written last.
    """
    spark = mart.sparkSession
    order = [*columns, *[c for c in mart.columns if c not in columns]]
    rows, index = f"{path}/rows", f"{path}/index"
    schema = mart.select(*order).withColumn(_PLACE, F.lit(0).cast("long")).withColumn(_PART, F.lit(0)).schema
    if refresh or not table_exists(spark, index, "part int, n bigint"):
        with small_tasks(spark):
            source = stage(mart.select(*order).withColumn(_PLACE, F.monotonically_increasing_id()), "copy-source")  # splits ties
            files = max(1, -(-source.count() // file_rows))
            by = [F.asc_nulls_last(c) for c in order]
            ranged = source.repartitionByRange(files, *by, F.col(_PLACE)).sortWithinPartitions(*by, F.col(_PLACE))
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
            placed = ranged.select(*order, place.alias(_PLACE), F.spark_partition_id().alias(_PART))
            placed.write.mode("overwrite").partitionBy(_PART).parquet(rows)
        written = spark.read.schema(schema).parquet(rows)
        counts = written.groupBy(F.col(_PART).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(index)
    found, before = [], 0
    for r in spark.read.schema("part int, n bigint").parquet(index).orderBy("part").collect():
        found.append((r["part"], r["n"], before))
        before += r["n"]
    return SortedCopy(spark.read.schema(schema).parquet(rows), tuple(found), tuple(order))


def page_after(copy: SortedCopy, after: int = 0, filters: Filters = Filters(), limit: int = 10) -> Page:
    """The ``limit`` rows that the filters leave from position ``after`` on.

    First the files that would fill the page without filters are opened; then, while it is
    not full, files with twice as many rows each time.
    """
    kept, left, opened, wanted, at = [], limit, [], limit, 0
    todo = [f for f in copy.files if f[1] + f[2] > after]
    while left > 0 and at < len(todo):
        some, rows = [], 0
        while rows < wanted and at < len(todo):
            some.append(todo[at])
            rows += todo[at][1] - max(0, after - todo[at][2])
            at += 1
        wanted *= 2
        opened += [part for part, _, _ in some]
        first, _, before = some[0]
        beyond = (F.col(_PART) > first) | (F.col(_PLACE) >= max(0, after - before))
        rows = filtered(copy.rows.where(F.col(_PART).isin([part for part, _, _ in some]) & beyond), filters)
        found = rows.orderBy(_PART, _PLACE).limit(left).collect()  # one page at most
        kept += found
        left -= len(found)
    spark = copy.rows.sparkSession
    rows = spark.createDataFrame([tuple(r)[: len(copy.columns)] for r in kept], copy.rows.select(*copy.columns).schema)
    following = None
    if left == 0 and kept:
        before = {part: n for part, _, n in copy.files}
        following = before[kept[-1][_PART]] + kept[-1][_PLACE] + 1
    return Page(rows, following if following is not None and following < copy.total else None, tuple(opened))


def walk(copy: SortedCopy, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
    """All rows that the filters leave, with ``page`` (from 1) and ``position`` in the walk (from 0).

    The files are read once; what is left of each of them is numbered file by file.
    """
    with small_tasks(copy.rows.sparkSession):
        kept = stage(filtered(copy.rows, filters), "walk", _PART)
    sizes = kept.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = sizes.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(_PART).orderBy(_PLACE)) - 1
    numbered = kept.withColumn("number", number).join(offsets, _PART).withColumn("position", F.col("number") + F.col("before"))
    page = (F.floor(F.col("position") / F.lit(limit)) + 1).cast("long")
    return numbered.select(*copy.columns, page.alias("page"), F.col("position").cast("long").alias("position"))
