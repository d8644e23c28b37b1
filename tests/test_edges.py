"""Rows at the edges: missing values, unknown ids, day ends, wildcards, first weeks."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from depotlens.functions.dates import week_label
from depotlens.functions.numbers import exact_sum, percent, round_half_up
from depotlens.operators import billing, catalog, dashboard, ledger, maintenance, reports
from depotlens.plans.durable import shared_folder

ENTRY = (
    "id long, type string, productId long, warehouseId long, locationId long, quantity double, unitPrice double, "
    "reference string, notes string, customer string, transactionDate timestamp"
)


def entries(spark, *listed):
    return spark.createDataFrame(list(listed), ENTRY)


def entry(id, type, product, quantity, when, warehouse=1, price=2.0, reference=None, notes=None, customer=None):
    return (id, type, product, warehouse, None, quantity, price, reference, notes, customer, when)


NOON = datetime(2024, 1, 10, 12)


def test_missing_type_subtracts_and_missing_price_is_left_out(spark, seed):
    t = entries(spark, entry(1, "inbound", 1, 10.0, NOON), entry(2, None, 1, 3.0, NOON), entry(3, "inbound", 1, 1.0, NOON, price=None))
    tables = {**seed, "transactions": t}
    assert rows(ledger.on_hand(tables), "onHand") == [(8.0,)]
    assert ledger.ledger_summary(tables).first()["totalInValue"] == 20.0


def test_unknown_products_fall_into_one_group(spark, seed):
    t = entries(
        spark,
        entry(1, "outbound", 98, 1.0, NOON), entry(2, "outbound", 99, 2.0, NOON),
        entry(3, "outbound", 1, 1.0, NOON, warehouse=77),
    )
    top = reports.top_products({**seed, "transactions": t})
    assert rows(top, "id", "warehouseName", "transactionCount", "totalQuantity") == [
        (None, "Kho Hà Nội", 2, 3.0), (1, None, 1, 1.0),
    ]
    names = by(ledger.ledger_list({**seed, "transactions": t}), "id", "productName", "warehouseName")
    assert names[1] == (None, "Kho Hà Nội") and names[3] == ("Laptop Dell Inspiron", None)


def test_day_end_is_inside_a_date_range_but_not_a_moment_range(spark, seed):
    late = datetime(2024, 1, 31, 23, 59, 59)
    t = entries(spark, entry(1, "outbound", 1, 1.0, late), entry(2, "outbound", 1, 1.0, datetime(2024, 2, 1)))
    summary = ledger.ledger_summary({**seed, "transactions": t}, start="2024-01-31", end="2024-01-31")
    assert summary.first()["totalTransactions"] == 1
    slips = spark.createDataFrame(
        [("a", "IN", "PN-1", 1, [(1, 4.0)], late), ("b", "OUT", "PX-1", 1, [(1, 1.0)], datetime(2024, 1, 31))],
        "id string, type string, code string, warehouseId long, lines array<struct<productId:long,qty:double>>, createdAt timestamp",
    )
    report = dashboard.movement_report({**seed, "documents": slips}, 1, "2024-01-01", "2024-01-31")
    assert by(report, "id", "inQty", "outQty", "balance")[1] == (0.0, 1.0, -1.0)


def test_open_ended_periods_keep_later_rows(spark, seed):
    days = [datetime(2024, 1, d) for d in (1, 5, 9)]
    t = entries(spark, *[entry(i, "inbound", 1, 1.0, d) for i, d in enumerate(days)])
    daily = ledger.ledger_daily({**seed, "transactions": t}, days=3, as_of="2024-01-07")
    assert [str(r[0]) for r in rows(daily, "date")] == ["2024-01-09", "2024-01-05"]
    assert ledger.ledger_daily({**seed, "transactions": t}, days=4).count() == 2


def test_weeks_count_from_the_first_monday(spark):
    days = spark.sql("SELECT explode(sequence(date'2018-12-25', date'2026-01-10')) AS d")
    labels = days.select("d", week_label(F.col("d")).alias("w")).collect()
    assert all(r["w"] == r["d"].strftime("%Y-W%W") for r in labels)


def test_trend_against_zero_and_unknown_metric(spark, seed):
    t = entries(
        spark,
        entry(1, "inbound", 1, 5.0, datetime(2024, 1, 1), price=0.0),
        entry(2, "inbound", 1, 5.0, datetime(2024, 1, 3), price=2.0),
        entry(3, "inbound", 1, 4.0, datetime(2024, 1, 9), price=1.0),
    )
    tables = {**seed, "transactions": t}
    assert rows(reports.trends(tables, metric="nonsense"), "value", "change", "changeType") == [
        (0.0, 0.0, "stable"), (10.0, 0.0, "stable"), (4.0, -60.0, "decrease"),
    ]
    assert rows(reports.revenue_timeline(tables, group_by="nonsense"), "period") == []


def test_transfer_states(spark, seed):
    def leg(id, type, reference, warehouse, day=10):
        return entry(id, type, 1, 1.0, datetime(2024, 1, day), warehouse, reference=reference)

    t = entries(
        spark,
        leg(1, "inbound", "TR-in", 1),
        leg(2, "outbound", "TR-out", 1),
        leg(3, "outbound", "tr-both", 1), leg(4, "inbound", "tr-both", 2),
        leg(5, "outbound", "TR-lost", 77), leg(6, "inbound", "TR-lost", 2),
        leg(7, "adjustment", "TR-none", 1),
        # Newest first: in, out, in, out -> the last one read is an outbound.
        leg(8, "inbound", "TR-four", 2, 14), leg(9, "outbound", "TR-four", 1, 13),
        leg(10, "inbound", "TR-four", 3, 12), leg(11, "outbound", "TR-four", 2, 11),
        leg(12, "outbound", "XTR-1", 1),
    )
    found = by(reports.transfer_report({**seed, "transactions": t}), "reference", "fromWarehouse", "toWarehouse", "status")
    assert found == {
        "TR-in": (None, "Kho Hà Nội", "pending"),
        "TR-out": ("Kho Hà Nội", None, "in_progress"),
        "tr-both": ("Kho Hà Nội", "Kho TP.HCM", "completed"),
        "TR-lost": (None, "Kho TP.HCM", "in_progress"),
        "TR-none": (None, None, "pending"),
        "TR-four": ("Kho TP.HCM", "Kho Đà Nẵng", "in_progress"),
    }


def test_search_terms(spark, seed):
    names = ["100% wool", "100 pct", "a_b", "axb", "ĐÈN bàn", "đèn bàn", "LAMP", "back\\slash"]
    products = seed["products"].limit(1).drop("id", "name").crossJoin(
        spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    ).withColumns({c: F.lit(None).cast("string") for c in ("sku", "description", "manufacturer")})

    def found(term):
        return {r[0] for r in rows(catalog.product_search({**seed, "products": products}, term), "name")}

    assert found("100%") == {"100% wool", "100 pct"}
    assert found("a_b") == {"a_b", "axb"}
    assert found("lamp") == {"LAMP"}
    assert found("đèn") == {"đèn bàn"}
    assert found("k\\s") == {"back\\slash"}


def test_shared_names(spark, seed):
    staff = seed["maintenance_staff"].withColumn("name", F.lit("Same"))
    plans = seed["maintenance_plans"].withColumn("responsibleStaff", F.lit("Same"))
    solved = seed["incidents"].withColumn("resolvedBy", F.lit("Same"))
    tables = {**seed, "maintenance_staff": staff, "maintenance_plans": plans, "incidents": solved.union(solved).limit(3)}
    assert set(rows(maintenance.staff_workload(tables), "assignedPlans", "assignedIncidents")) == {(6, 6)}
    assert set(rows(maintenance.staff_workload(tables, mode="exact"), "assignedPlans", "assignedIncidents")) == {(2, 3)}
    twins = seed["customers"].withColumn("name", F.lit("Công ty TNHH ABC"))
    assert billing.customer_transactions({**seed, "customers": twins}).count() == 3


def test_warehouse_without_area_and_location_without_capacity(spark, seed):
    warehouses = seed["warehouses"].withColumns({"totalArea": F.lit(0.0), "usedArea": F.lit(None).cast("double")})
    tables = {**seed, "warehouses": warehouses}
    assert {r for r in rows(reports.warehouse_efficiency(tables), "utilizationRate", "valueEfficiency", "productDensity")} == {(0.0, 0.0, 0.0)}
    assert set(rows(reports.storage_cost(tables), "costPerSqm")) == {(0.0,)}
    locations = seed["locations"].withColumn("capacity", F.lit(None).cast("double"))
    mapped = by(catalog.warehouse_map({**seed, "locations": locations}), "id", "utilizationRate", "availableCapacity")
    assert mapped[1] == (0.0, -5.0)
    assert catalog.available_locations({**seed, "locations": locations}).count() == 0
    assert catalog.available_locations(seed).count() == 6
    lonely = seed["warehouses"].withColumn("id", F.col("id") + 100)
    stats = catalog.location_stats_by_warehouse({**seed, "warehouses": lonely}).first()
    assert (stats["totalLocations"], stats["totalArea"], stats["availableCapacity"]) == (0, None, 0.0)


def test_missing_stock_bounds(seed):
    products = seed["products"].withColumns({c: F.lit(None).cast("double") for c in ("minStock", "maxStock")})
    tables = {**seed, "products": products}
    after_the_query = by(reports.inventory_by_product(tables), "sku", "stockStatus")
    assert after_the_query["LAP-DELL-001"] == "high" and after_the_query["PRINT-HP-001"] == "low"
    assert set(by(catalog.warehouse_stock(tables), "sku", "stockStatus").values()) == {"normal"}
    assert reports.low_stock_alert(tables).count() == 0


def test_product_without_known_warehouse_has_no_stock(spark, seed):
    homeless = seed["products"].withColumn("warehouseId", F.lit(77).cast("long"))
    t = entries(spark, entry(1, "inbound", 1, 5.0, NOON, warehouse=77))
    tables = {**seed, "products": homeless, "transactions": t}
    assert by(catalog.product_stock(tables, 1), "id", "warehouseId", "onHand") == {1: (None, 0.0)}
    assert by(catalog.warehouse_stock(tables, 77), "id", "onHand")[1] == 5.0


def test_sums_do_not_depend_on_order(spark):
    values = [0.1] * 1000 + [1e11, 0.07, 0.0001]
    forwards = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    assert forwards.agg(exact_sum(F.col("v"))).first()[0] == 100000000100.0701


def test_rounding(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "a double, b double")
    assert rows(df.select(percent(F.col("a"), F.col("b")))) == [(33.33,), (0.0,), (0.0,), (0.0,)]
    halves = spark.createDataFrame([(2.5,), (-2.5,), (3.49,)], "x double")
    assert rows(halves.select(round_half_up(F.col("x")))) == [(3.0,), (-2.0,), (3.0,)]


def test_large_invoices_are_nested_in_parts(spark, seed):
    invoices = spark.createDataFrame([(1, "INV-1", 1), (2, "INV-2", 1), (3, "INV-3", 9)], "id long, invoiceNumber string, customerId long")
    items = spark.range(100).selectExpr(
        "id", "CASE WHEN id < 95 THEN 1L ELSE 2L END AS invoiceId", "1 + id % 8 AS productId",
        "1.0D AS quantity", "2.0D AS unitPrice", "2.0D AS total", "CAST(NULL AS STRING) AS notes",
    )
    tables = {**seed, "invoices": invoices, "invoice_items": items}
    small = billing.invoice_document(tables, part_limit=10)
    sizes = small.select("id", "part", F.size("items").alias("n"), "items").collect()
    assert sum(r["n"] for r in sizes if r["id"] == 1) == 95
    assert len({i["id"] for r in sizes if r["id"] == 1 for i in r["items"]}) == 95
    assert len([r for r in sizes if r["id"] == 1]) > 5 and max(r["n"] for r in sizes) < 40
    assert sorted((r["id"], r["part"], r["n"]) for r in sizes if r["id"] != 1) == [(2, 0, 5), (3, 0, 0)]
    whole = by(billing.invoice_document(tables), "id", "part", "items")
    assert len(whole[1][1]) == 95 and whole[1][1][0]["productSku"] is not None


class Settings:
    """As much of a session as tells where intermediate tables go."""

    def __init__(self, **settings):
        self.settings = {name.replace("_", "."): value for name, value in settings.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_intermediate_tables_go_to_shared_folders():
    local = {"spark_master": "local[4]", "spark_sql_warehouse_dir": "file:/work/warehouse"}
    cluster = {**local, "spark_master": "yarn"}
    assert shared_folder(Settings(**local)) == "file:/work/warehouse/_intermediate"
    assert shared_folder(Settings(**cluster, spark_checkpoint_dir="s3a://b/c/")) == "s3a://b/c"
    assert shared_folder(Settings(**{**cluster, "spark_sql_warehouse_dir": "hdfs:///w"})) == "hdfs:///w/_intermediate"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Settings(**cluster))
