"""Changes of stored tables, and look-ups of hot keys."""

from __future__ import annotations

import os
import random
from datetime import datetime

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from depotlens.operators import batch, versions
from depotlens.plans import buckets, snapshot
from depotlens.plans.durable import materialize
from depotlens.plans.lookups import frequent_keys, lookup, lookup_skewed
from depotlens.sources import files

DAY = [datetime(2024, 1, d) for d in range(1, 10)]
PRODUCT = "id long, name string, sku string, unitPrice double, updatedAt timestamp"


def data_files(path):
    """{folder below the table: its data files with their times}"""
    found = {}
    for folder, _, names in os.walk(path):
        kept = [(n, os.stat(f"{folder}/{n}").st_mtime_ns) for n in sorted(names) if n.endswith(".parquet")]
        if kept and "_layout" not in folder:
            found[os.path.relpath(folder, path)] = kept
    return found


def products(spark, n=200):
    return spark.createDataFrame([(i, f"p{i}", f"S{i}", float(i), DAY[0]) for i in range(n)], PRODUCT)


def text(frame):
    return sorted(map(str, frame.collect()))


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    target = products(spark)
    stored = buckets.write(target, str(tmp_path / "t"), buckets=32)
    assert text(stored.rows()) == text(target)
    before = data_files(tmp_path / "t")
    changes = spark.createDataFrame([(7, "seven", "S7", 1.0, DAY[2]), (9, "", "S9", 1.0, DAY[2]), (5000, "new", "N", 2.0, DAY[1])], PRODUCT)
    touched = stored.touched(changes)
    assert 1 <= len(touched) <= 3
    expected, refused = batch.upsert_latest(target, changes, "products", insert=True)
    rejected = versions.upsert(stored, changes, "products", insert=True)
    assert text(stored.rows()) == text(expected) and text(rejected) == text(refused)
    after = data_files(tmp_path / "t")
    changed = {folder for folder in before | after if before.get(folder) != after.get(folder)}
    assert changed <= {f"_bucket={b}" for b in touched}
    # Done again, it is the same table.
    versions.upsert(stored, changes, "products", insert=True)
    assert text(stored.rows()) == text(expected)


def test_the_target_is_not_shuffled(spark, tmp_path):
    stored = buckets.write(products(spark), str(tmp_path / "t"), buckets=8)
    changes = materialize(spark.createDataFrame([(7, "seven", "S7", 1.0, DAY[2])], PRODUCT), "changes")
    version, _ = batch.upsert_latest(stored.rows(stored.touched(changes)), changes, "products")
    plan = version._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "_bucket" in scan


def test_deletes_empty_a_bucket_and_ids_of_any_width_meet(spark, tmp_path):
    target = products(spark, 40).unionByName(products(spark, 1).withColumn("id", F.lit(None).cast("long")))
    stored = buckets.write(target, str(tmp_path / "t"), buckets=16)
    ids = spark.createDataFrame([(i,) for i in range(40)] + [(99,), (99,)], "id int")
    unknown = versions.plain_delete(stored, ids)
    assert rows(unknown, "id", "reject_reason") == [(99, "id is not known")]
    assert rows(stored.rows(), "id") == [(None,)]
    assert versions.plain_delete(stored, ids.limit(0)).count() == 0
    reopened = buckets.open_stored(spark, str(tmp_path / "t"))
    assert (reopened.key, reopened.buckets, reopened.schema) == ("id", 16, stored.schema)


def test_rows_of_other_buckets_are_an_error(spark, tmp_path):
    stored = buckets.write(products(spark), str(tmp_path / "t"), buckets=8)
    before = data_files(tmp_path / "t")
    with pytest.raises(ValueError, match="not replaced"):
        stored.replace(stored.rows(), [0])
    assert data_files(tmp_path / "t") == before


def test_empty_tables(spark, tmp_path):
    stored = buckets.write(products(spark).limit(0), str(tmp_path / "t"), buckets=4)
    assert stored.rows().count() == 0
    changes = spark.createDataFrame([(7, "seven", "S7", 1.0, DAY[2])], PRODUCT)
    assert rows(versions.upsert(stored, changes, "products"), "reject_reason") == [("id is not known",)]
    versions.upsert(stored, changes, "products", insert=True)
    assert rows(stored.rows(), "id", "name") == [(7, "seven")]
    nothing = versions.upsert(stored, changes.limit(0), "products")
    assert nothing.count() == 0 and stored.rows().count() == 1


def test_items_follow_their_invoices(spark, tmp_path):
    rng = random.Random(5)
    heads = spark.createDataFrame([(i, 0.0, 8.0, 0.0, 0.0) for i in range(60)], "id long, subtotal double, taxRate double, taxAmount double, total double")
    # A third of all items are of one invoice.
    lines = [(rng.choice([3, rng.randrange(60), rng.randrange(60)]), n, float(n % 7), 2.5, n % 7 * 2.5) for n in range(600)]
    items = spark.createDataFrame(lines, "invoiceId long, lineNo long, quantity double, unitPrice double, total double")
    new = spark.createDataFrame([(3, 1, 2.0, 10.0), (8, 1, 1.0, 4.0), (999, 1, 1.0, 1.0)], "invoiceId long, lineNo long, quantity double, unitPrice double")
    stored = buckets.write(heads, str(tmp_path / "i"), buckets=16), buckets.write(items, str(tmp_path / "l"), "invoiceId", 8)
    expected = batch.replace_children(heads, items, new)
    for _ in range(2):
        rejected = versions.replace_children(*stored, new)
        assert text(stored[0].rows()) == text(expected[0])
        assert text(stored[1].rows().select(*items.columns)) == text(expected[1].select(*items.columns))
        assert rows(rejected, "invoiceId") == [(999,)]
    gone = spark.createDataFrame([(3,), (5,), (777,)], "id long")
    expected = batch.cascade_delete(stored[0].rows(), stored[1].rows(), gone)
    expected = [text(frame) for frame in expected]
    unknown = versions.cascade_delete(*stored, gone)
    assert [text(stored[0].rows()), text(stored[1].rows()), text(unknown)] == expected


def test_guards_hold_in_stored_tables(spark, seed, tmp_path):
    ids = spark.createDataFrame([(1,), (6,), (50,)], "id long")
    stored = buckets.write(seed["products"], str(tmp_path / "p"), buckets=4)
    held = versions.guarded_delete(seed, "products", stored, ids)
    assert rows(held, "id", "transactionCount") == [(1, 5)]
    assert sorted(r[0] for r in rows(stored.rows(), "id")) == [1, 2, 3, 4, 5, 7, 8]


def test_ledger_changes_replace_their_months(spark, tmp_path):
    kind = "id long, type string, productId long, warehouseId long, quantity double, unitPrice double, transactionDate timestamp"
    lines = [(i, "inbound", i % 3, 1, float(i), 1.0, None if i == 59 else datetime(2024, 1 + i % 6, 1 + i % 28)) for i in range(60)]
    path, sums = str(tmp_path / "ledger"), str(tmp_path / "sums")
    files.append_ledger(spark.createDataFrame(lines, kind), path)
    snapshot.build(spark.read.parquet(path), sums)
    before = data_files(path)
    # One line moves from January to May, one stays in March, one is unknown.
    changes = spark.createDataFrame(
        [(0, 100.0, 2.0, datetime(2024, 5, 3), DAY[0]), (2, 200.0, 2.0, datetime(2024, 3, 3), DAY[0]), (500, 1.0, 1.0, datetime(2024, 3, 3), DAY[0])],
        "id long, quantity double, unitPrice double, transactionDate timestamp, updatedAt timestamp",
    )
    whole = spark.createDataFrame(lines, kind)
    expected, refused = batch.upsert_latest(whole, changes, "transactions")
    rejected, months = versions.upsert_ledger(spark.read.parquet(path), path, changes)
    assert months == ["2024-01", "2024-03", "2024-05"]
    assert text(spark.read.parquet(path).drop("month")) == text(expected) and text(rejected) == text(refused)
    unknown, gone = versions.delete_from_ledger(spark.read.parquet(path), path, spark.createDataFrame([(2,), (59,), (-1,)], "id long"))
    assert gone == ["2024-03", "none"] and rows(unknown, "id") == [(-1,)]
    assert text(spark.read.parquet(path).drop("month")) == text(expected.filter("id NOT IN (2, 59)"))
    after = data_files(path)
    assert {m for m in before if before[m] == after.get(m)} == {"month=2024-02", "month=2024-04", "month=2024-06"}
    snapshot.refresh(spark.read.parquet(path), sums, sorted({*months, *gone}))
    fresh = str(tmp_path / "fresh")
    snapshot.build(spark.read.parquet(path), fresh)
    assert text(snapshot.totals(snapshot.read(spark, sums))) == text(snapshot.totals(snapshot.read(spark, fresh)))
    assert versions.delete_from_ledger(spark.read.parquet(path), path, spark.createDataFrame([(-1,)], "id long"))[1] == []


@pytest.fixture
def plain_joins(spark):
    """Neither run-time re-planning nor broadcasts by Spark's own choice."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def largest_task(frame):
    return max(row["count"] for row in frame.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_hot_key_is_spread(spark, plain_joins):
    facts = spark.range(0, 10_000, 1, 8).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN 7 WHEN id % 100 = 0 THEN NULL WHEN id % 100 = 50 THEN -1 ELSE id % 500 END AS k"
    )
    dimension = spark.range(600).selectExpr("id", "concat('n', id) AS name", "id * 2 AS twice")
    wanted = {"name": "name", "double": "twice"}
    plain = lookup(facts, dimension, "k", **wanted)
    found = lookup_skewed(facts, dimension, "k", **wanted)
    assert found.columns == plain.columns and text(found) == text(plain)
    assert largest_task(plain) >= 9_000
    assert largest_task(found) <= 2_000


def test_frequent_keys_are_few(spark):
    facts = spark.createDataFrame([(k,) for k in [1] * 50 + [2] * 30 + [None] * 40 + list(range(10, 30))], "k long")
    assert sorted(rows(frequent_keys(facts, "k", 4))) == [(1,), (2,)]
    assert frequent_keys(facts, "k", 50).count() == 2
    empty = facts.limit(0)
    dimension = spark.createDataFrame([(1, "one")], "id long, name string")
    assert rows(lookup_skewed(empty, dimension, "k", name="name")) == []
    few = spark.createDataFrame([(None,), (None,), (5,)], "k long")
    assert by(lookup_skewed(few, dimension, "k", name="name"), "k", "name") == {None: None, 5: None}
