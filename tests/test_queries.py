"""Registered queries against DuckDB, and the shape of their plans."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from helpers import SF_DIR

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracles import oracle_sql
from checks.queries import OPERATORS
from checks.synthetic import SyntheticTables
from depotlens.operators import catalog, ledger, reports


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    """Text queries beyond SQL are tested by brute force, in their own folder."""
    assert set(OPERATORS) == set(oracle_sql())
    assert set(oracle_sql()) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert 0 < contract.entry(spark).count() <= 20


@pytest.mark.parametrize("name", list(OPERATORS))
def test_matches_sql(spark, duck, name):
    assert difference(spark, duck, SF_DIR, name) is None


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    return SyntheticTables(spark, SF_DIR)


def test_date_range_reaches_the_scan(tables):
    text = plan(ledger.ledger_summary(tables, start="1996-01-01", end="1996-01-31"))
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in text
    assert "LessThan(l_shipdate,1996-02-01T00:00)" in text


def test_only_needed_columns_are_read(tables):
    text = plan(ledger.on_hand(tables))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in text


def test_top_k_is_taken_before_the_lookups(tables):
    text = plan(ledger.ledger_list(tables))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["warehouse_performance", "warehouse_list", "location_stats_by_warehouse", "staff_workload"])
def test_no_product_of_children(tables, name):
    text = plan(OPERATORS[name](tables))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


BEYOND_BROADCAST = [
    (reports.low_stock_alert, {"limit": None}),
    (reports.inventory_by_warehouse, {}),
    (reports.adjustment_report, {}),
    (catalog.warehouse_map, {}),
]


@pytest.mark.parametrize(("operator", "params"), BEYOND_BROADCAST)
def test_same_result_when_nothing_may_be_broadcast(spark, tables, operator, params):
    small = sorted(map(str, operator(tables, **params).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = operator(tables, **params)
        assert "BroadcastHashJoin" not in plan(frame)
        assert sorted(map(str, frame.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
