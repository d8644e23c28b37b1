"""Posting in order, against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from depotlens.operators import posting

REQUEST = "id long, type string, productId long, warehouseId long, quantity double, transactionDate timestamp"
START = datetime(2024, 1, 1)


def looped(requests, stock):
    """{id: (available, accepted)}"""
    balances, decided = dict(stock), {}
    for id_, kind, product, warehouse, quantity, _ in sorted(requests, key=lambda r: (r[5], r[0])):
        balance = balances.get((product, warehouse), 0.0)
        accepted = kind not in ("outbound", "transfer") or balance >= quantity
        decided[id_] = (balance, accepted)
        if accepted:
            balances[product, warehouse] = balance + (quantity if kind == "inbound" else -quantity)
    return decided


def generated(seed, count, hot_share, kinds):
    rng = random.Random(seed)
    made = []
    for id_ in range(count):
        product = 1 if rng.random() < hot_share else rng.randint(2, 6)
        when = START + timedelta(minutes=rng.randint(0, count // 2))
        made.append((id_, rng.choice(kinds), product, rng.randint(1, 2), float(rng.randint(1, 30)), when))
    rng.shuffle(made)
    return made


def ledger_of(spark, stock):
    data = [(i, "inbound", p, w, q, START) for i, ((p, w), q) in enumerate(stock.items())]
    return spark.createDataFrame(data, REQUEST)


def test_sequence(spark):
    requests = [
        (1, "outbound", 1, 1, 7.0, START), (2, "outbound", 1, 1, 5.0, START), (3, "outbound", 1, 1, 3.0, START),
    ]
    accepted, rejected = posting.post_outbound(spark.createDataFrame(requests, REQUEST), ledger_of(spark, {(1, 1): 10.0}))
    assert sorted(rows(accepted, "id")) == [(1,), (3,)]
    assert rows(rejected, "id", "available", "requested") == [(2, 3.0, 5.0)]


@pytest.mark.parametrize(
    ("seed", "kinds", "opening"),
    [
        (1, ["outbound"], 5_000.0),  # plenty at first, then exhausted
        (2, ["outbound", "transfer", "inbound", "inbound"], 20.0),  # refilled all the time
        (3, ["outbound", "adjustment", "inbound", "stocktake", "inbound"], 0.0),  # may fall below zero
        (4, ["outbound"], 1e6),  # nothing is rejected
    ],
)
def test_like_a_loop_with_a_hot_key_in_many_chunks(spark, seed, kinds, opening):
    requests = generated(seed, 1000, 0.5, kinds)
    stock = {(p, w): opening for p in range(1, 6) for w in (1, 2)} if opening else {}
    frame = spark.createDataFrame(requests, REQUEST).repartition(3)
    decided = posting.decide(frame, ledger_of(spark, stock), partitions=12)
    assert by(decided, "id", "available", "accepted") == looped(requests, stock)


@pytest.fixture
def written(monkeypatch):
    """The tables that are written while a decision is made, each the end of a pass."""
    labels = []
    write = posting.materialize
    monkeypatch.setattr(posting, "materialize", lambda df, label: labels.append(label) or write(df, label))
    return labels


PASSES = ["posting-events", "posting-bounds", "posting-starts"]


@pytest.mark.parametrize("length", [80, 300])
def test_alternating_requests_take_a_fixed_number_of_passes(spark, written, length):
    """Every chunk depends on the exact end of the one before."""
    requests = []
    for i in range(length):
        when = START + timedelta(minutes=i)
        requests.append((2 * i, "outbound", 1, 1, 1.0, when))
        requests.append((2 * i + 1, "outbound", 1, 1, float(length - i), when))
    stock = {(1, 1): float(length)}
    decided = posting.decide(spark.createDataFrame(requests, REQUEST), ledger_of(spark, stock), partitions=10)
    assert written == PASSES
    assert by(decided, "id", "available", "accepted") == looped(requests, stock)


def test_settled_chunks_are_not_folded_in_order(spark):
    """Plenty at first, then nothing: all chunks but the one between are known by their bounds."""
    requests = [(i, "outbound", 1, 1, 2.0, START + timedelta(minutes=i)) for i in range(400)]
    events = spark.createDataFrame(requests, REQUEST)
    bounds = []
    write = posting.materialize

    def kept(df, label):
        out = write(df, label)
        if label == "posting-bounds":
            bounds.append(out)
        return out

    posting.materialize = kept
    try:
        decided = posting.decide(events, ledger_of(spark, {(1, 1): 333.0}), partitions=8)
        assert by(decided, "id", "available", "accepted") == looped(requests, {(1, 1): 333.0})
    finally:
        posting.materialize = write
    verdicts = [r["verdict"] for r in bounds[0].filter("_part >= 0").orderBy("_part").collect()]
    assert verdicts.count("open") == 1
    assert verdicts == sorted(verdicts, key=["all", "open", "none"].index)


@pytest.mark.parametrize("kinds", [["outbound", "inbound"], ["outbound", "transfer", "adjustment", "inbound"]])
def test_only_hot_keys_are_cut(spark, written, kinds):
    requests = generated(8, 1500, 0.6, kinds)
    stock = {(p, w): 50.0 for p in range(1, 6) for w in (1, 2)}
    frame = spark.createDataFrame(requests, REQUEST).repartition(3)
    decided = posting.decide(frame, ledger_of(spark, stock), hot=200)
    assert by(decided, "id", "available", "accepted") == looped(requests, stock)
    assert written == ["posting-hot-keys", *PASSES]


def test_without_hot_keys_there_is_one_pass(spark, written):
    requests = generated(9, 300, 0.5, ["outbound", "inbound"])
    decided = posting.decide(spark.createDataFrame(requests, REQUEST), ledger_of(spark, {}))
    assert by(decided, "id", "available", "accepted") == looped(requests, {})
    assert written == []


def test_stock_from_stored_sums(spark, tmp_path):
    from depotlens.plans import snapshot

    requests = generated(10, 300, 0.5, ["outbound", "inbound"])
    stock = {(p, w): 40.0 for p in range(1, 6) for w in (1, 2)}
    lines = ledger_of(spark, stock).withColumn("unitPrice", F.lit(1.0))
    snapshot.build(lines, str(tmp_path / "stock"))
    decided = posting.decide(spark.createDataFrame(requests, REQUEST), snapshot.read(spark, str(tmp_path / "stock")))
    assert by(decided, "id", "available", "accepted") == looped(requests, stock)


TRANSFER = (
    "id long, productId long, fromWarehouseId long, toWarehouseId long, fromLocationId long, toLocationId long, "
    "quantity double, unitPrice double, reference string, notes string, transferDate timestamp"
)


def looped_transfers(requests, stock):
    balances, expected = dict(stock), {}
    for r in sorted(requests, key=lambda r: (r[10], r[0])):
        have = balances.get((r[1], r[2]), 0.0)
        expected[r[0]] = have >= r[6], have
        if have >= r[6]:
            balances[r[1], r[2]] = have - r[6]
            balances[r[1], r[3]] = balances.get((r[1], r[3]), 0.0) + r[6]
    return expected


def transfer(id_, product, source, target, quantity, minute):
    return (id_, product, source, target, None, None, float(quantity), 1.0, f"TR-{id_}", None, START + timedelta(minutes=minute))


def check_transfers(spark, requests, stock, **params):
    expected = looped_transfers(requests, stock)
    legs, rejected = posting.expand_transfers(spark.createDataFrame(requests, TRANSFER).repartition(3), ledger_of(spark, stock), **params)
    assert sorted(r[0] for r in rows(legs, "id")) == sorted(f"{i}-{side}" for i, (ok, _) in expected.items() if ok for side in ("in", "out"))
    assert by(rejected, "id", "available") == {i: have for i, (ok, have) in expected.items() if not ok}
    return legs


@pytest.mark.parametrize("params", [{}, {"partitions": 4}, {"partitions": 9}, {"hot": 60}])
def test_transfers_feed_later_transfers(spark, params):
    rng = random.Random(5)
    requests = [transfer(i, rng.randint(1, 2) if i % 3 else 1, rng.randint(1, 4), rng.randint(1, 4), rng.randint(1, 20), rng.randint(0, 400)) for i in range(160)]
    legs = check_transfers(spark, requests, {(1, 1): 40.0, (2, 3): 25.0}, **params)
    assert {r[0] for r in rows(legs, "type")} == {"inbound", "outbound"}


@pytest.mark.parametrize(("params", "passes"), [({}, []), ({"partitions": 6}, PASSES)])
def test_a_chain_of_transfers_takes_no_further_pass(spark, written, params, passes):
    """Each link is fed by the one before, and the last but one comes to nothing."""
    requests = [transfer(i, 1, i + 1, i + 2, 5.0 if i != 150 else 6.0, i) for i in range(200)]
    check_transfers(spark, requests, {(1, 1): 5.0}, **params)
    assert written == [*passes, "transfer-verdicts"]


def test_nine_places_count_across_partitions(spark):
    small = 0.000000001
    requests = [(i, "outbound", 1, 1, small, START + timedelta(minutes=i)) for i in range(10)]
    decided = posting.decide(spark.createDataFrame(requests, REQUEST), ledger_of(spark, {(1, 1): 5 * small}), partitions=4)
    assert by(decided, "id", "accepted") == {i: i < 5 for i in range(10)}


def test_blank_requests_are_rejected_and_blank_dates_filled(spark):
    late = datetime(2030, 1, 1)
    requests = [
        (1, "outbound", 1, 1, None, START), (2, "outbound", 1, 1, 0.0, START), (3, "outbound", None, 1, 1.0, START),
        (4, "outbound", 1, 1, 6.0, None), (5, "outbound", 1, 1, 6.0, START), (6, "outbound", 2, 1, 0.00004, START),
    ]
    posted, rejected = posting.post_outbound(
        spark.createDataFrame(requests, REQUEST), ledger_of(spark, {(1, 1): 10.0}), now=late
    )
    assert by(posted, "id", "transactionDate") == {5: START}
    assert by(rejected, "id", "reject_reason", "available") == {
        1: ("quantity is missing", None), 2: ("quantity is missing", None), 3: ("productId is missing", None),
        4: ("not enough stock", 4.0), 6: ("not enough stock", 0.0),
    }
    assert by(rejected, "id", "transactionDate")[4] == late


def test_adjustments(spark):
    requests = spark.createDataFrame(
        [(1, 1, 1, None, -4.0, "broken", None, START), (2, 1, 1, 7, 2.0, "found", "n", None), (3, 1, 1, 7, None, "x", "n", START),
         (4, 1, 1, 7, 1.0, "", "n", START)],
        "id long, productId long, warehouseId long, locationId long, quantity double, reason string, notes string, "
        "adjustmentDate timestamp",
    )
    posted, rejected = posting.expand_adjustments(requests, now=datetime(2030, 1, 1))
    assert by(posted, "id", "type", "quantity", "unitPrice", "reference", "transactionDate") == {
        1: ("outbound", 4.0, 0.0, "ADJUSTMENT: broken", START),
        2: ("inbound", 2.0, 0.0, "ADJUSTMENT: found", datetime(2030, 1, 1)),
    }
    assert by(rejected, "id", "reject_reason") == {3: "quantity is missing", 4: "reason is missing"}
