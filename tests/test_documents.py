"""Dashboard, search and files over browser-style documents."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from helpers import by, rows
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import batch, dashboard, search
from depotlens.plans.parts import nest_children
from depotlens.sources import files

SLIPS = [
    {"id": "t1", "type": "IN", "code": "PN-1", "warehouseId": "w1", "createdAt": "2024-01-30T10:00:00Z",
     "lines": [{"productId": "p1", "qty": 10}, {"productId": "p2", "qty": 4}]},
    {"id": "t2", "type": "OUT", "code": "PX-1", "warehouseId": "w1", "createdAt": "2024-01-31T09:00:00Z",
     "lines": [{"productId": "p1", "qty": 3}, {"productId": "p1", "qty": 1}, {"productId": "zz", "qty": 5}]},
    {"id": "t3", "type": "OUT", "code": "PX-2", "warehouseId": "w2", "createdAt": "2024-01-31T12:00:00Z", "lines": []},
    {"id": "t4", "type": "OUT", "code": "PX-3", "warehouseId": "w2", "createdAt": "2023-12-01T12:00:00Z",
     "lines": [{"productId": "p3", "qty": 2}]},
]
PRODUCTS = [("p1", "SP001", "Thùng carton", "Cái", 15000.0), ("p2", "EL001", "Máy quét", None, 0.5), ("p3", "", "Kệ", "", None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "slips.json"
    path.write_text("\n".join(json.dumps(s) for s in SLIPS), encoding="utf-8")
    return {
        "documents": files.read_documents(spark, str(path)),
        "products": spark.createDataFrame(PRODUCTS, "id string, sku string, name string, uom string, unitPrice double"),
        "warehouses": spark.createDataFrame(
            [("w1", "KHO1", 1200.0, 400.0, 120000.0, "Thường"), ("w2", "KHO2", 600.0, None, 180000.0, None)],
            "id string, code string, totalArea double, usedArea double, rentalPrice double, type string",
        ),
        "skus": spark.createDataFrame(
            [("s1", "p1", "SP001-01", "893", True), ("s2", "p1", "CTN-L", "894", False)], schemas.SKUS
        ),
    }


def test_kpis(tables):
    row = dashboard.dashboard_kpis(tables).first()
    # p2 has 4, p3 has -2: both are low. The free area of w2 is unknown.
    assert tuple(row) == (3, 2, 0, 2, 800.0, 15000.5)
    assert dashboard.dashboard_kpis(tables, as_of="2024-01-30 23:00:00").first()["inToday"] == 1


def test_day_series(tables):
    found = [(str(d), i, o) for d, i, o in rows(dashboard.in_out_last_days(tables))]
    assert len(found) == 7
    assert found[-2:] == [("2024-01-30", 1, 0), ("2024-01-31", 0, 2)] and found[0] == ("2024-01-25", 0, 0)
    trend = rows(dashboard.signed_value_trend(tables))
    assert len(trend) == 30
    assert [v for _, v in trend[-2:]] == [150002.0, -60000.0] and trend[0][1] == 0.0


def test_stock_and_moves(tables):
    assert rows(dashboard.top_on_hand(tables, 2), "code", "onHand") == [("SP001", 6.0), ("EL001", 4.0)]
    assert rows(dashboard.top_moved(tables, "OUT"), "productId", "code", "quantity") == [("zz", "?", 5.0), ("p1", "SP001", 4.0)]
    assert rows(dashboard.low_stock_share(tables)) == [(2, 1)]
    assert by(dashboard.movement_report(tables, "w1"), "id", "inQty", "outQty", "balance") == {
        "p1": (10.0, 4.0, 6.0), "p2": (4.0, 0.0, 4.0), "p3": (0.0, 0.0, 0.0),
    }


def test_revenue(tables):
    assert by(dashboard.revenue_by_warehouse(tables), "code", "revenue") == {"KHO1": 60000.0, "KHO2": 0.0}
    assert by(dashboard.revenue_by_group(tables), "productGroup", "revenue") == {"SP": 60000.0, "X": 0.0}


def test_areas_and_prices(spark, tables):
    assert rows(dashboard.area_utilization(tables)) == [(1000.0, 800.0)]
    assert by(dashboard.free_area_by_warehouse(tables), "code", "freeArea") == {"KHO1": 800.0, "KHO2": 600.0}
    raised = dashboard.reprice(tables, 10, "Thường")
    assert by(raised, "code", "rentalPrice") == {"KHO1": 132000.0, "KHO2": 198000.0}
    assert by(dashboard.reprice(tables, -5, "Lạnh"), "code", "rentalPrice") == {"KHO1": 120000.0, "KHO2": 180000.0}
    requests = spark.createDataFrame([("w1", 10.0, 3), ("w2", None, 2), ("w1", 2.0, None)], "warehouseId string, area double, months int")
    assert sorted(r[0] for r in rows(dashboard.rent_quote(tables, requests), "total")) == [0.0, 240000.0, 3600000.0]


def test_variance(spark, tables):
    counts = spark.createDataFrame([("p1", 5.0)], "productId string, countedQty double")
    assert by(dashboard.stocktake_variance(tables, counts, "w1"), "productId", "systemQty", "countedQty", "difference") == {
        "p1": (6.0, 5.0, -1.0), "p2": (4.0, 4.0, 0.0), "p3": (0.0, 0.0, 0.0),
    }
    assert {r[0] for r in rows(dashboard.stocktake_variance(tables), "difference")} == {0.0}


def test_cards(tables):
    cards = {k: json.loads(v) for k, v in rows(dashboard.product_card(tables, "now"))}
    assert cards["p1"] == {
        "id": "p1", "code": "SP001", "name": "Thùng carton", "uom": "Cái", "barcode": "893", "sku": "SP001-01",
        "manufacturer": "Công ty TNHH ABC", "onHand": 6, "lastUpdated": "now", "description": "Sản phẩm chất lượng cao",
    }
    assert (cards["p3"]["onHand"], cards["p3"]["uom"], cards["p3"]["sku"]) == (0, "Cái", "")


def test_ledger_rows(tables):
    ledger = batch.documents_to_ledger(tables["documents"], tables["products"])
    assert by(ledger, "id", "type", "quantity", "unitPrice") == {
        "t1-0": ("inbound", 10.0, 15000.0), "t1-1": ("inbound", 4.0, 0.5), "t2-0": ("outbound", 3.0, 15000.0),
        "t2-1": ("outbound", 1.0, 15000.0), "t2-2": ("outbound", 5.0, None), "t4-0": ("outbound", 2.0, None),
    }


def test_long_slips_in_parts(spark, tables):
    """A slip of 25,000 lines is one slip: its lines are numbered through and it is counted once."""
    slips = spark.createDataFrame(
        [("a", "IN", "PN-9", "w1", datetime(2024, 1, 31)), ("b", "IN", "PN-10", "w1", datetime(2024, 1, 31)), ("c", "OUT", "PX-9", "w1", datetime(2024, 1, 31))],
        "id string, type string, code string, warehouseId string, createdAt timestamp",
    )
    lines = spark.range(25_003).selectExpr(
        "CASE WHEN id < 25000 THEN 'a' ELSE 'b' END AS slip", "concat('p', 1 + id % 3) AS productId", "CAST(id % 50 AS double) AS qty", "id AS n"
    )
    nested = nest_children(slips, lines, "slip", F.struct("productId", "qty"), "lines", ["n"], 10_000).cache()
    shape = sorted(rows(nested, "id", "part", "partCount", "itemCount", F.size("lines")))
    assert shape == [("a", i, 3, 25_000, n) for i, n in enumerate((10_000, 10_000, 5_000))] + [("b", 0, 1, 3, 3), ("c", 0, 1, 0, 0)]
    ledger = batch.documents_to_ledger(nested, tables["products"]).cache()
    found = rows(ledger, "id", "productId", "quantity")
    assert sorted(r[0] for r in found) == sorted([f"a-{i}" for i in range(25_000)] + [f"b-{i}" for i in range(3)])
    # Numbers follow the order of the lines over the whole slip.
    numbered = sorted((int(i[2:]), p, q) for i, p, q in found if i[0] == "a")
    assert [r[1:] for r in numbered] == sorted((p, q) for _, p, q in numbered)
    given = {**tables, "documents": nested}
    assert rows(dashboard.in_out_last_days(given))[-1][1:] == (2, 1)
    assert dashboard.dashboard_kpis(given).first()[2:4] == (2, 1)
    counted = search._with_line_count(given, nested)
    assert sorted(rows(counted, "code", "lineCount")) == [("PN-10", 3), ("PN-9", 25_000), ("PX-9", 0)]


@pytest.fixture(scope="module")
def searchable(spark, tables):
    contracts = spark.createDataFrame(
        [("1", "HD001", "KH001", "Công ty TNHH ABC", "Nhập hàng", 50000000.0, "2024-01-01", "2024-12-31", "active", "Cung cấp"),
         ("2", "HD003", "KH003", "Công ty DEF", "Nhập hàng", 1234.5, "2024-03-01", "2024-08-31", "completed", "Mua")],
        schemas.CONTRACTS,
    )
    invoices = spark.createDataFrame(
        [("INV001", "KH001", "Công ty TNHH ABC", "Nhập", 16500000.0, "2024-01-15", "2024-02-15", "paid", "Tháng 1")],
        "code string, customerCode string, customerName string, type string, totalWithTax double, issueDate string, "
        "dueDate string, status string, description string",
    )
    customers = spark.createDataFrame(
        [("KH001", "Công ty TNHH ABC", "Nguyễn Văn A", "0901-EXT", "abc@email.com", "active"),
         ("KH004", "Công ty CP GHI", None, "0902", "ghi@email.com", "inactive")],
        "code string, name string, contactPerson string, phone string, email string, status string",
    )
    return {**tables, "contracts": contracts, "invoice_documents": invoices, "customers": customers}


def test_entity_search(searchable):
    found = rows(search.entity_search(searchable, "CÔNG TY TNHH"))
    assert sorted(found) == sorted([
        ("Khách hàng", "KH001", "Công ty TNHH ABC", "Liên hệ: Nguyễn Văn A - 0901-EXT", "Hoạt động"),
        ("Hợp đồng", "HD001", "Cung cấp", "KH: Công ty TNHH ABC - Giá trị: 50,000,000đ", "Hoạt động"),
        ("Hóa đơn", "INV001", "Tháng 1", "KH: Công ty TNHH ABC - Tổng: 16,500,000đ", "Đã thanh toán"),
    ])
    slips = search.entity_search(searchable, "px", "documents")
    assert sorted(rows(slips, "kind", "code", "name")) == [
        ("Phiếu Xuất", "PX-1", "3 dòng"), ("Phiếu Xuất", "PX-2", "0 dòng"), ("Phiếu Xuất", "PX-3", "1 dòng"),
    ]
    assert search.entity_search(searchable, "").count() == 3 + 4 + 2 + 2 + 1
    assert search.entity_search(searchable, "px", "transactions").count() == slips.count() > 0
    with pytest.raises(ValueError):
        search.entity_search(searchable, "", "unknown")


def test_other_searches(searchable):
    assert rows(search.advanced_search(searchable, start="2024-02-01"), "code", "info") == [
        ("HD003", "KH: Công ty DEF - Giá trị: 1,234.5đ")
    ]
    assert rows(search.advanced_search(searchable, customer="KH001", status="paid"), "code") == [("INV001",)]
    assert rows(search.filtered_customers(searchable, "văn a"), "code") == [("KH001",)]
    assert search.filtered_customers(searchable, "EXT").count() == 0  # phones are not folded
    assert search.filtered_customers(searchable, status="inactive").count() == 1
    assert search.filtered_products(searchable, "SP0").count() == 1
    assert search.filtered_invoices(searchable, "tháng", type="Xuất").count() == 0


def test_files(spark, tmp_path, seed):
    df = spark.createDataFrame([("a", 'says "hi", twice', None), ("b", "x", 1.5)], "k string, v string, n double")
    files.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8").splitlines()
    assert text[0] == '"k","v","n"'
    assert text[1:] == [r[0] for r in rows(files.csv_lines(df))] == ['"a","says ""hi"", twice",""', '"b","x","1.5"']
    files.write_json(df, str(tmp_path / "json"))
    assert {json.loads(r[0])["k"] for r in rows(files.json_rows(df))} == {"a", "b"}
    assert spark.read.json(str(tmp_path / "json")).filter("n IS NULL").count() == 1

    ledger = str(tmp_path / "warehouse" / "transactions")
    files.append_ledger(seed["transactions"], ledger)
    files.append_ledger(seed["transactions"].withColumn("transactionDate", F.lit(datetime(2024, 2, 1))), ledger)
    tables = files.read_tables(spark, str(tmp_path / "warehouse"), ["transactions"])
    assert tables["transactions"].count() == 30
    assert spark.read.parquet(ledger).filter("month = '2024-02'").count() == 15
    assert spark.sql("SELECT count(*) FROM transactions").first()[0] == 30
