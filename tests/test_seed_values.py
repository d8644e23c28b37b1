"""Values worked out by hand on the seed data."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from depotlens.operators import billing, catalog, ledger, maintenance, reports

MILLION = 1_000_000.0


def test_ledger_has_two_legs_per_transfer(seed):
    assert seed["transactions"].count() == 15


def test_on_hand(seed):
    named = (
        ledger.on_hand(seed)
        .join(seed["products"].select(F.col("id").alias("productId"), "sku"), "productId")
        .join(seed["warehouses"].select(F.col("id").alias("warehouseId"), "code"), "warehouseId")
        .withColumn("key", F.concat_ws("@", "sku", "code"))
    )
    assert by(named, "key", "onHand") == {
        "LAP-DELL-001@HN001": 23.0,
        "PHONE-SAMS-001@HN001": 55.0,
        "FURN-DESK-001@HCM001": 22.0,
        "FURN-CHAIR-001@HCM001": 81.0,
        "BOOK-WARE-001@DN001": 195.0,
        "LAP-DELL-001@HCM001": 15.0,
        "PHONE-SAMS-001@HCM001": 20.0,
    }


def test_overview(seed):
    row = reports.overview(seed).first().asDict()
    assert (row["totalInboundQuantity"], row["totalOutboundQuantity"]) == (495.0, 78.0)
    assert (row["totalInboundValue"], row["totalOutboundValue"]) == (3600 * MILLION, 1295 * MILLION)
    assert row["turnoverRate"] == 15.76
    assert (row["totalWarehouses"], row["totalProducts"], row["totalCustomers"]) == (3, 8, 3)
    assert (row["totalTransactions"], row["activeDays"]) == (15, 1)


def test_overview_outside_range(seed):
    row = reports.overview(seed, "2023-01-01", "2023-12-31").first().asDict()
    assert row["totalTransactions"] == row["activeDays"] == row["totalInboundValue"] == row["turnoverRate"] == 0
    assert row["totalProducts"] == 8
    # One bound alone is ignored.
    assert reports.overview(seed, "2025-01-01").first()["totalTransactions"] == 15


def test_inventory_by_warehouse(seed):
    found = by(
        reports.inventory_by_warehouse(seed), "warehouseCode",
        "totalInboundQuantity", "totalOutboundQuantity", "onHandQuantity", "totalInventoryValue",
    )
    assert found == {
        "HN001": (150.0, 70.0, 78.0, 2750 * MILLION),
        "HCM001": (110.0, 8.0, 103.0, 195 * MILLION),
        "DN001": (200.0, 0.0, 195.0, 30 * MILLION),
    }


LOW = ["FURN-DINING-001", "MON-DELL-001", "PRINT-HP-001"]


def test_stock_status(seed):
    found = by(reports.inventory_by_product(seed), "sku", "stockStatus")
    assert sorted(sku for sku, s in found.items() if s == "low") == LOW
    assert set(found.values()) == {"low", "normal"}
    assert sorted(by(reports.inventory_by_product(seed, stock_status_is="low"), "sku", "id")) == LOW


def test_low_stock_alert(seed):
    found = by(reports.low_stock_alert(seed), "sku", "onHand", "alertLevel", "shortage", "shortageValue")
    assert found == {
        "PRINT-HP-001": (0.0, "critical", 8.0, 28 * MILLION),
        "MON-DELL-001": (0.0, "critical", 12.0, 33.6 * MILLION),
        "FURN-DINING-001": (0.0, "critical", 3.0, 13.5 * MILLION),
    }
    assert reports.low_stock_alert(seed, limit=2).count() == 2


def test_fan_out_modes(seed):
    exact = by(reports.warehouse_performance(seed, mode="exact"), "warehouseCode", "totalInboundQuantity")
    assert exact == {"HN001": 150.0, "HCM001": 145.0, "DN001": 200.0}
    reference = by(reports.warehouse_performance(seed), "warehouseCode", "totalInboundQuantity")
    assert reference == {"HN001": 1350.0, "HCM001": 870.0, "DN001": 400.0}
    with pytest.raises(ValueError):
        reports.warehouse_performance(seed, mode="other")


def test_storage_cost(seed):
    found = by(reports.storage_cost(seed), "warehouseCode", "totalMonthlyCost", "costPerSqm")
    assert found == {
        "HN001": (305 * MILLION, 61000.0),
        "HCM001": (603.9 * MILLION, 75487.5),
        "DN001": (180.6 * MILLION, 60200.0),
    }
    # Both dates and no row in the range: no warehouse is left.
    assert reports.storage_cost(seed, start="2023-01-01", end="2023-12-31").count() == 0


def test_adjustments_and_stocktake(seed):
    found = by(reports.adjustment_report(seed), "sku", "quantity", "adjustmentType", "absoluteQuantity")
    assert found == {"LAP-DELL-001": (2.0, "Tăng", 2.0), "FURN-CHAIR-001": (-1.0, "Giảm", 1.0)}
    assert rows(reports.stocktake_report(seed), "sku", "quantity") == [("BOOK-WARE-001", 5.0)]
    # Vietnamese letters keep their case, ASCII ones do not.
    assert reports.adjustment_report(seed, reason="đIỀU").count() == 0
    assert reports.adjustment_report(seed, reason="DO HAO").count() == 1


def test_transfer_is_completed_when_outbound_is_read_first(seed):
    found = by(reports.transfer_report(seed), "reference", "fromWarehouse", "toWarehouse", "status")
    assert found["TR-001-2024"] == ("Kho Hà Nội", "Kho TP.HCM", "completed")


def test_transfer_is_in_progress_when_inbound_is_newer(seed):
    later = F.when(F.col("type") == "inbound", F.lit(datetime(2024, 1, 11))).otherwise(F.col("transactionDate"))
    tables = {**seed, "transactions": seed["transactions"].withColumn("transactionDate", later)}
    assert set(by(reports.transfer_report(tables), "reference", "status").values()) == {"in_progress"}


def test_warehouse_value_at_catalog_price(seed):
    exact = by(catalog.warehouse_list(seed, mode="exact"), "code", "totalInventoryValue")
    assert exact["DN001"] == 195 * 150000.0
    assert exact["HN001"] == 23 * 15 * MILLION + 55 * 20 * MILLION
    reference = by(catalog.warehouse_list(seed), "code", "totalInventoryValue")
    assert reference["HN001"] == 3 * exact["HN001"]
    assert "totalInventoryValue" not in catalog.warehouse_list(seed, id=1).columns


def test_first_location_with_the_code_is_taken(seed):
    # Location codes repeat: HCM and DN products end up at the Hanoi location of that code.
    assert by(seed["products"], "sku", "locationId")["FURN-DESK-001"] == 1
    assert by(catalog.location_list(seed, id=1, with_value=False), "id", "productCount")[1] == 5


def test_maintenance(seed):
    assert by(maintenance.staff_workload(seed), "code", "assignedPlans", "assignedIncidents") == {
        "MT-001": (1, 0),
        "MT-002": (1, 0),
    }
    stats = maintenance.maintenance_stats(seed).first()
    assert (stats["totalPlans"], stats["totalPlannedCost"], stats["averageDuration"]) == (2, 13 * MILLION, 2.5)
    assert maintenance.maintenance_stats(seed, "2030-01-01", "2030-01-02").first()["averageDuration"] == 0.0
    assert rows(maintenance.maintenance_plans(seed), "id") == [(1,), (2,)]


def test_customers_by_name(seed):
    assert by(billing.customer_transactions(seed, id=2), "reference", "productSku") == {"SO-002-2024": "PHONE-SAMS-001"}
    assert set(by(billing.customer_list(seed), "code", "totalInvoices").values()) == {0}


def test_empty_ledger(seed):
    tables = {**seed, "transactions": seed["transactions"].limit(0)}
    summary = ledger.ledger_summary(tables).first()
    assert summary["totalTransactions"] == 0 and summary["totalInQuantity"] is None
    assert reports.overview(tables).first()["totalInboundValue"] == 0.0
    assert set(by(reports.inventory_by_warehouse(tables), "id", "onHandQuantity").values()) == {0.0}
    assert set(by(reports.warehouse_performance(tables), "id", "totalTransactions").values()) == {0}
    assert reports.trends(tables).count() == 0
    assert ledger.ledger_daily(tables).count() == 0
