"""Stored partial sums, replaced months and repeated appends."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from helpers import rows

from depotlens.functions.numbers import PARTS
from depotlens.operators import ledger, reports
from depotlens.plans import snapshot
from depotlens.plans.stock import AMOUNTS, movements
from depotlens.sources import files

LINE = "id long, type string, productId long, warehouseId long, quantity double, unitPrice double, transactionDate timestamp"


def line(rng, id_):
    when = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 4000))
    amount = rng.choice([None, 0.1, 0.00004, -3.0, 12.5, 7e9, 1e15, 123456.789, -0.000000001])
    return (id_, rng.choice(["inbound", "outbound", "transfer", None]), rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([1, 2, None]), amount, rng.choice([None, 0.3, 10.25]), when)


@pytest.fixture(scope="module")
def history(spark):
    """(earlier ledger, ledger now, came, went)"""
    rng = random.Random(4)
    before = {i: line(rng, i) for i in range(400)}
    now = dict(before)
    early = [i for i, r in before.items() if r[6] is not None and r[6] < datetime(2024, 2, 15)]
    for i in rng.sample(early, 20):
        del now[i]
    for i in rng.sample([i for i in early if i in now], 20):
        now[i] = (*before[i][:4], 99.25, *before[i][5:6], datetime(2024, 1, 20))
    for i in range(1000, 1030):
        now[i] = (*line(rng, i)[:6], datetime(2024, 1, rng.randint(1, 31)))
    came = [r for i, r in now.items() if before.get(i) != r]
    went = [r for i, r in before.items() if now.get(i) != r]
    return tuple(spark.createDataFrame(list(x), LINE) for x in (before.values(), now.values(), came, went))


def full(frame):
    return sorted(map(str, movements(frame, snapshot.KEY, tuple(AMOUNTS)).collect()))


def of(state):
    return sorted(map(str, snapshot.totals(state).collect()))


def test_state_and_changes_are_the_full_sums(spark, history, tmp_path):
    before, now, came, went = history
    path = str(tmp_path / "stock")
    snapshot.build(before, path)
    assert of(snapshot.read(spark, path)) == full(before)
    assert of(snapshot.with_changes(snapshot.read(spark, path), came, went)) == full(now)
    assert of(snapshot.with_changes(snapshot.read(spark, path), None, before)) == []
    months = snapshot.changed_months(came, went)
    assert months == ["2024-01", "2024-02"]
    snapshot.refresh(now, path, months)
    assert of(snapshot.read(spark, path)) == full(now)


def test_only_changed_months_are_read_and_written(spark, history, tmp_path):
    before, now, came, went = history
    stored, path = str(tmp_path / "ledger"), str(tmp_path / "stock")
    files.append_ledger(before, stored)
    snapshot.build(spark.read.parquet(stored), path)
    closed = {f: f.stat().st_mtime_ns for top in (stored, path) for f in (tmp_path / top).rglob("month=*/*.parquet") if not f.parent.name.endswith(("2024-01", "2024-02"))}
    months = snapshot.changed_months(came, went)
    files.replace_months(now, stored, months)
    version = spark.read.parquet(stored)
    assert sorted(map(str, version.drop("month").collect())) == sorted(map(str, now.collect()))
    refreshed = snapshot.partial_sums(version.filter(version.month.isin(months)))
    assert re.search(r"PartitionFilters: \[month#\d+ IN \(2024-01,2024-02\)\]", refreshed._jdf.queryExecution().toString())
    snapshot.refresh(version, path, months)
    assert of(snapshot.read(spark, path)) == full(now)
    assert closed == {f: f.stat().st_mtime_ns for f in closed}


def test_a_report_from_the_state_reads_no_ledger(spark, seed, tmp_path):
    path = str(tmp_path / "stock")
    snapshot.build(seed["transactions"], path)
    state = snapshot.read(spark, path)
    without = {name: table for name, table in seed.items() if name != "transactions"} | {"stock_snapshot": state}
    for operator in (ledger.on_hand, reports.inventory_by_product, reports.inventory_by_warehouse, reports.low_stock_alert):
        assert sorted(map(str, operator(without).collect())) == sorted(map(str, operator(seed).collect()))
    assert all("/stock/" in f for f in ledger.on_hand(without).inputFiles())


def test_months_without_lines(spark, history, tmp_path):
    before, _, _, _ = history
    stored, path = str(tmp_path / "ledger"), str(tmp_path / "stock")
    files.append_ledger(before, stored)
    snapshot.build(before, path)
    left = before.filter("transactionDate >= '2024-03-01' OR transactionDate IS NULL")
    gone = ["2024-01", "2024-02"]
    files.replace_months(left, stored, gone)
    snapshot.refresh(spark.read.parquet(stored), path, gone)
    assert spark.read.parquet(stored).count() == left.count()
    assert of(snapshot.read(spark, path)) == full(left)
    assert {p for p in PARTS} == set(snapshot.read(spark, path).schema["onHand"].dataType.names)


def test_an_append_can_be_repeated(spark, history, tmp_path):
    before, _, came, _ = history
    path = str(tmp_path / "ledger")
    for name, lines in (("monday", before), ("tuesday", came), ("monday", before), ("tuesday", came)):
        files.append_ledger(lines, path, batch=name)
    stored = spark.read.parquet(path)
    assert stored.count() == before.count() + came.count()
    assert {r[0] for r in stored.select("batch").distinct().collect()} == {"monday", "tuesday"}


def test_broken_documents_are_told_apart(spark, tmp_path):
    good = {"id": "t1", "type": "IN", "lines": [{"productId": "p1", "qty": 2}], "unknown": 1}
    broken = ['{"id": "t2", "type": "IN", "lines": [{"prod', '{"id": "t3", "lines": [{"productId": "p", "qty": "many"}]}', "no json", "[1, 2]", '{"id": "t4", "lines": 7}']
    (tmp_path / "slips.json").write_text("\n".join([json.dumps(good), "", "  ", *broken, "{}"]), encoding="utf-8")
    sound, rejected = files.sound_documents(spark, str(tmp_path))
    assert [(r.id, r.lines[0].qty if r.lines else None) for r in sound.collect()] == [("t1", 2.0), (None, None)]
    assert sorted(r.line for r in rejected.collect()) == sorted(broken)
    assert rows(files.read_documents(spark, str(tmp_path)), "id") == [("t1",), (None,)]


def test_a_look_up_by_id_opens_one_file(spark, tmp_path):
    path = tmp_path / "by_id"
    files.write_by_id(spark.range(0, 40_000, numPartitions=4).repartition(4), str(path), partitions=4)
    bounds = []
    for file in path.glob("*.parquet"):
        data = pq.ParquetFile(file).metadata
        bounds += [(g.column(0).statistics.min, g.column(0).statistics.max) for g in map(data.row_group, range(data.num_row_groups))]
    assert len(bounds) > 1 and all(sum(low <= i <= high for low, high in bounds) == 1 for i in (0, 12_345, 39_999))
    found = spark.read.parquet(str(path)).filter("id = 12345")
    assert found.collect()[0][0] == 12345
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,12345)]" in found._jdf.queryExecution().toString()
