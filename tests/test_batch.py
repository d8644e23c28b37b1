from __future__ import annotations

from datetime import datetime

from helpers import by, rows
from pyspark.sql import functions as F

from depotlens.operators import batch

DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def test_required_allowed_and_defaults(spark):
    incoming = spark.createDataFrame(
        [(1, "A", "C1", None), (2, "", "C2", "Laos"), (3, "B", None, ""), (4, "D", "C4", "Laos")],
        "id long, name string, code string, country string",
    )
    accepted, rejected = batch.validate_batch(incoming, "customers")
    assert by(accepted, "id", "country", "creditLimit") == {1: ("Vietnam", 0.0), 4: ("Laos", 0.0)}
    assert by(rejected, "id", "reject_reason") == {2: "name is missing", 3: "code is missing"}


def test_zero_counts_as_missing(spark):
    incoming = spark.createDataFrame(
        [(1, "inbound", 1, 1, 0.0), (2, "loan", 1, 1, 1.0), (3, "inbound", 1, 1, -2.0), (4, None, 1, 1, 1.0)],
        "id long, type string, productId long, warehouseId long, quantity double",
    )
    accepted, rejected = batch.validate_batch(incoming, "transactions")
    assert rows(accepted, "id") == [(3,)]
    assert by(rejected, "id", "reject_reason") == {
        1: "quantity is missing", 2: "type is not allowed", 4: "type is missing",
    }


def test_area_and_items(spark):
    areas = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, None)], "id long, usedArea double")
    assert rows(batch.validate_batch(areas, "area_usage")[0], "id") == [(1,)]
    invoices = spark.createDataFrame(
        [(1, "I1", 1, DAY[0], [1]), (2, "I2", 1, DAY[0], [])],
        "id long, invoiceNumber string, customerId long, invoiceDate timestamp, items array<int>",
    )
    accepted, rejected = batch.validate_batch(invoices, "invoices")
    assert rows(accepted, "id", "taxRate") == [(1, 0.0)]
    assert rows(rejected, "reject_reason") == [("items is missing",)]
    plans = spark.createDataFrame([(1, 1, "t", DAY[0], 0, "done")], "id long, warehouseId long, title string, plannedDate timestamp, estimatedDuration int, status string")
    assert rows(batch.validate_batch(plans, "maintenance_plans")[0], "estimatedDuration", "status", "type") == [(1, "planned", "preventive")]


def test_first_of_a_new_key_wins(spark):
    target = spark.createDataFrame([("old",)], "sku string")
    incoming = spark.createDataFrame(
        [(3, "new"), (1, "new"), (2, "old"), (5, "own"), (6, None)], "id long, sku string"
    )
    accepted, rejected = batch.reject_duplicates(incoming, target, "sku")
    assert sorted(rows(accepted, "id")) == [(1,), (5,)]
    assert sorted(rows(rejected, "id")) == [(2,), (3,), (6,)]


def test_newest_change_overwrites_the_whole_record(spark, seed):
    changes = spark.createDataFrame(
        [(1, "one", "S1", 5.0, DAY[0]), (1, "uno", "S1", None, DAY[3]), (1, "eins", "S1", 7.0, DAY[1]), (99, "new", "S9", 1.0, DAY[0])],
        "id long, name string, sku string, unitPrice double, updatedAt timestamp",
    )
    target = seed["products"].withColumns({"updatedAt": F.lit(DAY[0]), "isActive": F.lit(True)})
    version, rejected = batch.upsert_latest(target, changes, "products", insert=True)
    assert rejected.count() == 0
    version = by(version, "id", "name", "unitPrice", "category", "isActive")
    assert len(version) == 9
    assert version[1] == ("uno", None, None, True)  # isActive is not touched by an update
    assert version[2][0] == "Điện thoại Samsung Galaxy"
    assert version[99] == ("new", 1.0, None, None)
    version, rejected = batch.upsert_latest(target, changes, "products")
    assert version.count() == 8
    assert rows(rejected, "id", "reject_reason") == [(99, "id is not known")]


def test_blank_changes_are_rejected_and_older_ones_count(spark, seed):
    changes = spark.createDataFrame(
        [(1, "one", "S1", DAY[0]), (1, "", "S1", DAY[3]), (2, "two", None, DAY[1]), (None, "who", "S0", DAY[1])],
        "id long, name string, sku string, updatedAt timestamp",
    )
    version, rejected = batch.upsert_latest(seed["products"], changes, "products")
    names = by(version, "id", "name")
    assert names[1] == "one" and names[2] != "two"
    reasons = sorted(r[0] for r in rows(rejected, "reject_reason"))
    assert reasons == ["id is not known", "name is missing", "sku is missing"]
    status = spark.createDataFrame([(1, "broken", DAY[0])], "id long, status string, updatedAt timestamp")
    assert rows(batch.upsert_latest(seed["locations"], status, "location_status")[1], "reject_reason") == [("status is not allowed",)]


def test_single_column_updates(spark, seed):
    used = spark.createDataFrame([(1, 1200.0, DAY[2])], "id long, usedArea double, updatedAt timestamp")
    version = by(batch.upsert_latest(seed["warehouses"], used, "area_usage")[0], "id", "usedArea", "name")
    assert version[1] == (1200.0, "Kho Hà Nội") and version[2] == (0.0, "Kho TP.HCM")
    moved = spark.createDataFrame([(1, 5.0, DAY[2])], "id long, quantity double, updatedAt timestamp")
    row = batch.upsert_latest(seed["transactions"], moved, "transactions")[0].filter("id = 1").first()
    assert (row["quantity"], row["unitPrice"], row["type"], row["transactionDate"]) == (5.0, None, "inbound", DAY[2])


def test_items_are_replaced_and_totals_follow(spark):
    invoices = spark.createDataFrame(
        [(1, 10.0, 8.0, 0.8, 10.8), (2, 20.0, 0.0, 0.0, 20.0)],
        "id long, subtotal double, taxRate double, taxAmount double, total double",
    )
    items = spark.createDataFrame([(1, 1, 5.0, 2.0, 10.0), (2, 1, 10.0, 2.0, 20.0)], "invoiceId long, productId long, quantity double, unitPrice double, total double")
    new = spark.createDataFrame([(1, 2, 3.0, 100.0), (1, 3, 1.0, 50.0), (9, 1, 1.0, 1.0)], "invoiceId long, productId long, quantity double, unitPrice double")
    versions = batch.replace_children(invoices, items, new)
    assert by(versions[0], "id", "subtotal", "taxAmount", "total") == {1: (350.0, 28.0, 378.0), 2: (20.0, 0.0, 20.0)}
    assert sorted(rows(versions[1], "invoiceId", "productId", "total")) == [(1, 2, 300.0), (1, 3, 50.0), (2, 1, 20.0)]
    assert rows(versions[2], "invoiceId", "reject_reason") == [(9, "invoiceId is not known")]


def test_update_of_an_invoice_sets_its_header(spark):
    invoices = spark.createDataFrame(
        [(1, "A", 7, "x", 10.0, 8.0, 0.8, 10.8), (2, "B", 7, "y", 20.0, 0.0, 0.0, 20.0), (3, "C", 7, "z", 1.0, 5.0, 0.05, 1.05), (4, "D", 7, "z", 1.0, 5.0, 0.05, 1.05)],
        "id long, invoiceNumber string, customerId long, notes string, subtotal double, taxRate double, taxAmount double, total double",
    )
    items = spark.createDataFrame([(n, 1, 1.0, 1.0, 1.0) for n in (1, 2, 3, 4)], "invoiceId long, productId long, quantity double, unitPrice double, total double")
    item = [(5, 2.0, 3.0)]
    documents = spark.createDataFrame(
        [(1, "A2", 8, "2024-01-01", item), (2, "A", 7, "2024-01-01", item), (3, "N", 7, "2024-01-01", []), (9, "K", 7, "2024-01-01", item), (4, "A2", 7, "2024-01-01", item)],
        "id long, invoiceNumber string, customerId long, invoiceDate string, items array<struct<productId:long,quantity:double,unitPrice:double>>",
    )
    heads, lines, rejected = batch.update_invoices(invoices, items, documents)
    assert heads.columns == invoices.columns
    assert by(heads, "id", "invoiceNumber", "customerId", "notes", "taxRate", "total")[1] == ("A2", 8, None, 0.0, 6.0)
    assert by(heads, "id", "invoiceNumber", "notes") | {1: None} == {1: None, 2: ("B", "y"), 3: ("C", "z"), 4: ("D", "z")}
    assert sorted(rows(lines, "invoiceId", "productId", "total")) == [(1, 5, 6.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)]
    assert by(rejected, "id", "reject_reason") == {
        2: "invoiceNumber exists", 3: "items is missing", 4: "invoiceNumber exists", 9: "id is not known",
    }
    posted = batch.post_invoices(documents.withColumn("id", F.col("id") + 100), invoices)
    assert sorted(rows(posted[0], "id")) == [(101,), (109,)]
    assert by(posted[2], "id", "reject_reason") == {102: "invoiceNumber exists", 103: "items is missing", 104: "invoiceNumber exists"}


def test_guarded_deletes(spark, seed):
    ids = spark.createDataFrame([(1,), (6,), (6,), (50,)], "id long")
    kept, rejected = batch.guarded_delete(seed, "products", ids)
    assert sorted(r[0] for r in rows(kept, "id")) == [1, 2, 3, 4, 5, 7, 8]
    assert rows(rejected, "id", "transactionCount") == [(1, 5)]
    kept, rejected = batch.guarded_delete(seed, "warehouses", seed["warehouses"])
    assert kept.count() == 3
    assert by(rejected, "id", "productCount", "transactionCount")[3] == (2, 2)
    kept, _ = batch.guarded_delete(seed, "customers", seed["customers"])
    assert kept.count() == 0


def test_cascade_and_plan_status(spark, seed):
    invoices = spark.createDataFrame([(1,), (2,)], "id long")
    items = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "invoiceId long, productId long")
    heads, lines, unknown = batch.cascade_delete(invoices, items, spark.createDataFrame([(2,), (5,)], "id long"))
    assert rows(heads) == [(1,)] and rows(lines) == [(1, 1)]
    assert rows(unknown, "id", "reject_reason") == [(5, "id is not known")]
    progress = spark.createDataFrame(
        [(1, 1, "in_progress", DAY[1]), (2, 1, "completed", DAY[3]), (3, 1, "in_progress", DAY[2]), (4, 77, "completed", DAY[2])],
        "id long, planId long, status string, updatedAt timestamp",
    )
    version = by(batch.latest_plan_status(seed["maintenance_plans"], progress), "id", "status", "updatedAt")
    assert version == {1: ("completed", DAY[3]), 2: ("planned", None)}


def test_location_has_to_be_in_the_warehouse_in_exact_mode(spark, seed):
    coded = spark.createDataFrame(
        [(1, "CAI", "HCM001", "A01"), (2, "CAI", "HCM001", "B01"), (3, "XX", "HCM001", "A01")],
        "id long, uomCode string, warehouseCode string, locationCode string",
    )
    tables = [seed[n] for n in ("uoms", "warehouses", "locations")]
    assert by(batch.resolve_products(coded, *tables), "id", "locationId") == {1: 1, 2: 3}
    assert by(batch.resolve_products(coded, *tables, mode="exact"), "id", "locationId") == {1: 4}
