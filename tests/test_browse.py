import glob
import math

import pytest

from ridestats.plans import browse, explore
from ridestats.plans.explore import Filters
from ridestats.sources import scratch, stage
from test_explore import COLUMNS


def mart_of(spark, n=300):
    rows = [(None if i % 11 == 0 else f"s{i * 7 % 40:02d}", "end", i % 24, "Monday", False, 1 + i % 3, 1.25, 50.0, 1, 10.0, "casual",
             [None, float("nan"), 1.0, 2.0, 30.0][i % 5], 30, 0.39) for i in range(n)]
    return spark.createDataFrame(rows + rows[:3] * 40, COLUMNS).repartition(5)


def text(rows):
    return [repr(tuple(r)) for r in rows]


def in_order(mart, copy):
    from pyspark.sql import functions as F

    return text(mart.select(*copy.columns).orderBy(*[F.asc_nulls_last(c) for c in copy.columns]).collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("copies"))


@pytest.mark.parametrize("limit,columns", [(50, ("start_station_id",)), (33, ("hour", "start_station_id")), (1000, ())])
def test_pages_follow_each_other_and_open_their_files(spark, folder, limit, columns):
    mart = mart_of(spark)
    copy = browse.sorted_copy(mart, f"{folder}/{limit}", columns, file_rows=60)
    assert copy.total == 420 and len(copy.files) == 7 and all(n < 150 for _, n, _ in copy.files)
    seen, at, opened = [], 0, []
    while at is not None:
        page = browse.page_after(copy, at, limit=limit)
        got = page.rows.collect()
        # Rows read for a page: those of the files that hold it.
        last = at + limit - 1
        assert page.opened == tuple(part for part, n, before in copy.files if before + n > at and before <= last)
        seen, at, opened = seen + text(got), page.next, opened + [page.opened]
        assert 0 < len(got) <= limit
    assert seen == in_order(mart, copy)
    assert sum(map(len, opened)) <= len(copy.files) + len(opened)


def test_a_deep_page_opens_one_file(spark, folder):
    copy = browse.sorted_copy(mart_of(spark), f"{folder}/deep", ("hour",), file_rows=100)
    page = browse.page_after(copy, after=copy.files[3][2] + 2, limit=5)
    assert page.opened == (copy.files[3][0],) and page.next == copy.files[3][2] + 7 and page.rows.count() == 5


def test_filters_and_walks(spark, folder):
    mart, filters = mart_of(spark), Filters(station_filter="^s[0-2]", month_filter=2, min_revenue=1.0)
    copy = browse.sorted_copy(mart, f"{folder}/walk", ("start_station_id", "hour"), file_rows=50)
    want = in_order(explore.filtered(mart, filters), copy)
    walked = browse.walk(copy, filters, 7).orderBy("position").collect()
    assert [repr(tuple(r)[:-2]) for r in walked] == want
    assert [r["position"] for r in walked] == list(range(len(want))) and [r["page"] for r in walked] == [1 + i // 7 for i in range(len(want))]
    seen, at = [], 0
    while at is not None:
        page = browse.page_after(copy, at, filters, 7)
        seen, at = seen + text(page.rows.collect()), page.next
    assert seen == want
    nothing = Filters(month_filter=9)
    assert browse.page_after(copy, 0, nothing, 7).rows.count() == 0 and browse.walk(copy, nothing, 7).count() == 0


def test_a_walk_reads_each_file_once(spark, folder):
    copy = browse.sorted_copy(mart_of(spark), f"{folder}/once", ("hour",), file_rows=100)
    files = [f for f in glob.glob(f"{folder}/once/rows/*/*.parquet")]
    assert len(files) == len(copy.files)
    plan = browse.walk(copy, Filters(), 10)._jdf.queryExecution().toString()
    assert "once/rows" not in plan  # what is left of the files was written once, the walk is numbered from that


def test_the_copy_is_kept_until_refreshed_and_may_be_empty(spark, folder):
    mart = mart_of(spark, 20)
    assert browse.sorted_copy(mart, f"{folder}/kept", (), 50).total == 140
    assert browse.sorted_copy(mart.limit(3), f"{folder}/kept", (), 50).total == 140
    assert browse.sorted_copy(mart.limit(3), f"{folder}/kept", (), 50, refresh=True).total == 3
    empty = browse.sorted_copy(mart.limit(0), f"{folder}/empty", ("hour",))
    assert empty.total == 0 and browse.page_after(empty).rows.count() == 0 and browse.walk(empty).count() == 0
    assert browse.page_after(empty).next is None and math.ceil(empty.total / 10) == 0


def test_copy_and_walk_run_in_tasks_of_bounded_size(spark, folder, monkeypatch):
    """The sort of the copy and the writers of a walk see small pieces of the files, whatever a session has set."""
    seen = []

    def staged(df, label, *parts):
        seen.append((label, spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")))
        return stage(df, label, *parts)

    monkeypatch.setattr(browse, "stage", staged)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    copy = browse.sorted_copy(mart_of(spark), f"{folder}/bounded", ("hour",), file_rows=60)
    assert browse.walk(copy, limit=50).count() == 420
    size = str(scratch.TASK_BYTES)
    assert seen == [("copy-source", size, size), ("walk", size, size)] and scratch.TASK_BYTES <= 16 << 20
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
