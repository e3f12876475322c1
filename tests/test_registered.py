"""Every registered query against its SQL on the smallest data."""

import ast
import re
from pathlib import Path

import pytest

import __spark_entry__ as registered
import check

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


# Those over texts have tests of their own.
NAMES = [n for n in registered.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) == ""


def test_entry_has_rows(spark):
    df = registered.entry(spark)
    assert df.columns == ["hour", "total_revenue", "avg_revenue", "trip_count"] and df.count() == 7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_the_marts(spark):
    from ridestats.plans import marts, reports
    from ridestats.sources import order_star

    star = order_star(spark, FOLDER)
    training = plan(marts.training_set(star))
    assert "LeftAnti" in training
    mart = plan(reports.revenue_by(marts.trip_mart(star), "hour"))
    for text in (training, mart):
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Dimensions of known small size never shuffle the trips.
    assert mart.count("BroadcastHashJoin") >= 4
    assert "EqualTo(year,2024)" in mart
    # Only the needed columns are read.
    assert not re.search(r"l_tax|l_extendedprice|temperature|o_totalprice", mart)


def test_explorer_page_is_a_top_k(spark):
    from ridestats.plans import explore
    from ridestats.sources import order_star
    from ridestats.plans import marts

    page = explore.page(marts.trip_mart(order_star(spark, FOLDER)), page=2)
    assert "TakeOrderedAndProject" in plan(page) or "CollectLimit" in plan(page)


def test_package_gathers_no_rows_of_data_size():
    """``collect``/``toPandas`` only at the places known to be bounded."""
    allowed = {
        "operators/iforest.py": 1,    # node table: trees x sample size
        "operators/neighbors.py": 2,  # pivots, sizes of their cells
        "operators/quantiles.py": 1,  # checked number of values
        "operators/sampling.py": 2,   # one row per stratum
        "plans/artifacts.py": 1,      # one row per feature (saved scaler)
        "plans/browse.py": 2,         # one row per file, the rows of one page
        "plans/marts.py": 2,          # months of a year
        "plans/revenue.py": 1,        # one row per model
        "sources/star.py": 1,         # ends of the parts that a table is read in
    }
    for file in (f for f in (ROOT / "ridestats").rglob("*.py") if "llm" not in f.parts):
        calls = [
            n.func.attr for n in ast.walk(ast.parse(file.read_text()))
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)
        ]
        gathered = sum(c in ("collect", "toPandas", "toLocalIterator") for c in calls)
        assert gathered <= allowed.get(str(file.relative_to(ROOT / "ridestats")), 0), file
        assert not {"localCheckpoint", "crossJoin", "coalesce_to_one"} & set(calls), file
