"""Sums keep what a double holds, in any order of rows; ledgers by month are pruned."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from depotlens.functions.numbers import exact_multiple, exact_sum, exact_total
from depotlens.operators import ledger
from depotlens.sources.files import append_ledger


def total(spark, values, function=exact_sum):
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    return rows.agg(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([0.00004] * 10, 0.0004),
        ([1e15, 0.25], 1e15 + 0.25),
        ([-0.1] * 3, -0.3),
        ([0.01] * 1000 + [None], 10.0),
        ([1e25, 2e25], 1e25 + 2e25),
        ([1e25, 1.5], 1e25),
        ([None], None),
        ([123456.789, -123456.788], 0.001),
    ],
)
def test_sums(spark, values, expected):
    assert total(spark, values) == expected
    assert total(spark, values, exact_total) == expected


def test_multiples(spark):
    row = spark.sql("SELECT 0.1D AS v, 3 AS n, 1e20D AS w").select(exact_multiple(F.col("v"), F.col("n")), exact_multiple(F.col("w"), F.col("n")))
    assert tuple(row.first()) == (0.3, 3e20)


def test_months_are_pruned(spark, seed, tmp_path):
    path = str(tmp_path / "ledger")
    rows = seed["transactions"]
    append_ledger(rows, path)
    written = spark.read.parquet(path)
    first = rows.agg(F.min("transactionDate")).first()[0]
    day = first.date() if isinstance(first, datetime.datetime) else first
    tables = {**seed, "transactions": written}
    summary = ledger.ledger_summary(tables, start=str(day), end=str(day))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert summary.collect() == ledger.ledger_summary(seed, start=str(day), end=str(day)).collect()
