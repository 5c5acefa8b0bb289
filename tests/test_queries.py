"""Every registered query against its SQL counterpart, and the shape of the plans."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from furrow.operators import ordered, profile, ranking, stats
from furrow.workload import ORACLES, QUERIES
from tests.compare import both, connect

SF_DIR = os.environ.get("FURROW_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert driver.queries().keys() >= QUERIES.keys() and driver.oracle_sql().keys() >= ORACLES.keys()


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, connection, name):
    ours, theirs = both(spark, connection, QUERIES[name], ORACLES[name], SF_DIR)
    assert ours == theirs


def limit(function, name: str, value: int, monkeypatch) -> None:
    """Another default for one argument of a function."""
    if name in (function.__kwdefaults__ or {}):
        monkeypatch.setitem(function.__kwdefaults__, name, value)
        return
    code = function.__code__
    names = code.co_varnames[: code.co_argcount][-len(function.__defaults__):]
    defaults = tuple(value if n == name else d for n, d in zip(names, function.__defaults__))
    monkeypatch.setattr(function, "__defaults__", defaults)


@needs_data
@pytest.mark.parametrize("name", [
    "forward_fill", "forward_fill_all", "user_series", "group_summary", "row_index", "soil_rank",
    "quantiles_by_group", "outliers_by_group", "outliers_iqr", "profile_describe",
])
def test_matches_sql_when_groups_are_large(spark, connection, monkeypatch, name):
    """The same queries with limits so low that groups are cut and columns searched."""
    limit(ordered.along, "rows_per_task", 40, monkeypatch)
    limit(ranking.ranks, "rows_per_task", 40, monkeypatch)
    limit(stats.quantiles, "rows_per_task", 60, monkeypatch)
    limit(stats.quantiles, "search_from", 30, monkeypatch)
    limit(profile.describe, "search_from", 30, monkeypatch)
    ours, theirs = both(spark, connection, QUERIES[name], ORACLES[name], SF_DIR)
    assert ours == theirs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_stays_in_the_engine(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in plan


@needs_data
def test_scan_reads_few_columns(spark):
    plan = plan_of(QUERIES["ts_pct_change"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_totalprice", "o_orderdate", "o_orderpriority"}


@needs_data
def test_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["assistant_counts"](spark, SF_DIR))
    assert "EqualTo(role,user)" in plan


@needs_data
def test_both_series_figures_share_one_window(spark):
    plan = plan_of(QUERIES["user_series"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and len(re.findall(r"\bWindow \[", plan)) == 1


@needs_data
def test_distinct_values_expand_no_rows(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    assert "Expand" not in plan_of(profile.columns_report(df)) and "Expand" in plan_of(df.agg(*[F.count_distinct(c) for c in df.columns]))


@needs_data
def test_entry(spark):
    assert driver.entry(spark).count() == 35
