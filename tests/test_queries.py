"""Every registered query with SQL against DuckDB on the smallest tables, and the plans."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("GUSTLINE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, SQL[name]) == []


@pytest.fixture(scope="module")
def flat_tables(tmp_path_factory):
    """The tables with the same ``k`` in all events: temperature and humidity are constant."""
    folder = tmp_path_factory.mktemp("flat")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    connect(SF).execute(f"COPY (SELECT * REPLACE ('{{\"k\": 99}}' AS props) FROM events) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["select_f_regression", "selected_names", "cumulative_importance", "family_share"])
def test_constant_columns_equal_sql(spark, flat_tables, name):
    rows = entry.queries()[name](spark, flat_tables)
    assert rows.count() > 0 and compare(rows, connect(flat_tables), SQL[name]) == []


def test_names_are_consistent():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = entry.entry(spark)
    assert df.count() > 0 and "category" in df.columns


@pytest.mark.parametrize("name", ["lag_features", "long_series_features", "timed_features", "merge_feeds", "psi"])
def test_no_single_partition_on_facts(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name != "psi":       # its totals over a handful of features end in one row
        assert "SinglePartition" not in plan


def test_feature_windows_sort_once(spark):
    """All lags and rolls share one window, apart from the row numbers of the position pass."""
    plan = entry.queries()["feature_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    features = [line for line in plan.splitlines() if "Window [" in line and "pm25" in line and "_lag_" not in line.split("Window [")[0]]
    assert len(features) <= 2
