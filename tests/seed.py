"""A small complete set of tables: the demonstration data of the original application.

The rows below are fixed values. Keys are given as codes and resolved by the operators.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import batch

WHEN = datetime(2024, 1, 10, 8, 0, 0)

UOMS = [("Cái", "CAI"), ("Kg", "KG"), ("Mét", "M"), ("Lít", "L"), ("Hộp", "HOP"), ("Thùng", "THUNG")]
WAREHOUSES = [
    ("Kho Hà Nội", "HN001", "Hà Nội", 5000.0, "general", 50000.0),
    ("Kho TP.HCM", "HCM001", "TP.HCM", 8000.0, "cold", 75000.0),
    ("Kho Đà Nẵng", "DN001", "Đà Nẵng", 3000.0, "hazardous", 60000.0),
]
LOCATIONS = [
    ("HN001", "A01", "Khu A - Vị trí 01", 100.0, 1000.0),
    ("HN001", "A02", "Khu A - Vị trí 02", 100.0, 1000.0),
    ("HN001", "B01", "Khu B - Vị trí 01", 150.0, 1500.0),
    ("HCM001", "A01", "Khu A - Vị trí 01", 200.0, 2000.0),
    ("HCM001", "A02", "Khu A - Vị trí 02", 200.0, 2000.0),
    ("DN001", "A01", "Khu A - Vị trí 01", 100.0, 1000.0),
]
PRODUCTS = [
    ("Laptop Dell Inspiron", "LAP-DELL-001", "Dell Inc.", "Electronics", "HN001", "A01", 10.0, 100.0, 15000000.0),
    ("Điện thoại Samsung Galaxy", "PHONE-SAMS-001", "Samsung Electronics", "Electronics", "HN001", "A02", 20.0, 200.0,
     20000000.0),
    ("Bàn làm việc", "FURN-DESK-001", "Furniture Co.", "Furniture", "HCM001", "A01", 5.0, 50.0, 2500000.0),
    ("Ghế văn phòng", "FURN-CHAIR-001", "Furniture Co.", "Furniture", "HCM001", "A02", 15.0, 100.0, 1500000.0),
    ("Sách quản lý kho", "BOOK-WARE-001", "Publishing House", "Books", "DN001", "A01", 50.0, 500.0, 150000.0),
    ("Máy in HP LaserJet", "PRINT-HP-001", "HP Inc.", "Electronics", "HN001", "B01", 8.0, 80.0, 3500000.0),
    ('Màn hình Dell 24"', "MON-DELL-001", "Dell Inc.", "Electronics", "HCM001", "A01", 12.0, 120.0, 2800000.0),
    ("Bàn ghế ăn", "FURN-DINING-001", "Furniture Co.", "Furniture", "DN001", "A01", 3.0, 30.0, 4500000.0),
]
CUSTOMERS = [
    ("Công ty TNHH ABC", "CUST-001", "Nguyễn Văn D", "090-1234-5678"),
    ("Công ty Cổ phần XYZ", "CUST-002", "Trần Thị E", "091-8765-4321"),
    ("Doanh nghiệp Tư nhân DEF", "CUST-003", "Lê Văn F", "092-1111-2222"),
]
ENTRIES = [
    ("inbound", "LAP-DELL-001", "HN001", 50.0, 15000000.0, "Dell Vietnam", None, "PO-001-2024", None),
    ("inbound", "PHONE-SAMS-001", "HN001", 100.0, 20000000.0, "Samsung Vietnam", None, "PO-002-2024", None),
    ("inbound", "FURN-DESK-001", "HCM001", 30.0, 2500000.0, "Furniture Co.", None, "PO-003-2024", None),
    ("inbound", "FURN-CHAIR-001", "HCM001", 80.0, 1500000.0, "Furniture Co.", None, "PO-004-2024", None),
    ("inbound", "BOOK-WARE-001", "DN001", 200.0, 150000.0, "Publishing House", None, "PO-005-2024", None),
    ("outbound", "LAP-DELL-001", "HN001", 10.0, 15000000.0, None, "Công ty TNHH ABC", "SO-001-2024", None),
    ("outbound", "PHONE-SAMS-001", "HN001", 25.0, 20000000.0, None, "Công ty Cổ phần XYZ", "SO-002-2024", None),
    ("outbound", "FURN-DESK-001", "HCM001", 8.0, 2500000.0, None, "Doanh nghiệp Tư nhân DEF", "SO-003-2024", None),
    ("transfer", "LAP-DELL-001", "HN001", 15.0, 15000000.0, None, None, "TR-001-2024", "Chuyển kho từ HN sang HCM"),
    ("transfer", "PHONE-SAMS-001", "HN001", 20.0, 20000000.0, None, None, "TR-002-2024", "Chuyển kho từ HN sang DN"),
    ("adjustment", "LAP-DELL-001", "HN001", 2.0, 0.0, None, None, "ADJ-001-2024", "Điều chỉnh do hao hụt"),
    ("adjustment", "FURN-CHAIR-001", "HCM001", -1.0, 0.0, None, None, "ADJ-002-2024", "Điều chỉnh do hư hỏng"),
    ("stocktake", "BOOK-WARE-001", "DN001", 5.0, 0.0, None, None, "ST-001-2024", "Kiểm kê định kỳ tháng 1"),
]
STAFF = [
    (1, "Nguyễn Văn Kỹ thuật", "MT-001", "Kỹ sư bảo trì", "Điện tử, cơ khí", "active"),
    (2, "Trần Thị Bảo trì", "MT-002", "Kỹ thuật viên", "Hệ thống làm lạnh", "active"),
]
PLANS = [
    (1, 1, "Bảo trì hệ thống điện kho HN", "preventive", "medium", date(2024, 2, 15), 2, 5000000.0,
     "Nguyễn Văn Kỹ thuật", "planned"),
    (2, 2, "Bảo trì hệ thống làm lạnh", "preventive", "high", date(2024, 2, 20), 3, 8000000.0,
     "Trần Thị Bảo trì", "planned"),
]
INCIDENTS = [
    (1, 1, "Sự cố mất điện", "electrical", "high", "reported", None),
    (2, 2, "Máy lạnh bị hỏng", "equipment", "medium", "reported", None),
]


def table(spark: SparkSession, schema, columns: str, data: list[tuple]) -> DataFrame:
    """Rows with some columns of a schema; the others are NULL."""
    names = columns.split()
    chosen = type(schema)([schema[n] for n in names])
    df = spark.createDataFrame(data, chosen)
    return df.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def numbered(data: list[tuple]) -> list[tuple]:
    return [(number, *row) for number, row in enumerate(data, 1)]


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    t: dict[str, DataFrame] = {}
    t["uoms"] = table(spark, schemas.UOMS, "id name code", numbered(UOMS))
    t["warehouses"] = table(
        spark, schemas.WAREHOUSES, "id name code city totalArea type rentalPrice", numbered(WAREHOUSES)
    ).withColumn("usedArea", F.lit(0.0))
    located = spark.createDataFrame(
        numbered(LOCATIONS), "id long, warehouseCode string, code string, name string, area double, capacity double"
    )
    t["locations"] = batch.resolve_key(located, t["warehouses"], "warehouseCode", "code", "warehouseId").withColumns(
        {"type": F.lit("storage"), "status": F.lit("available")}
    )
    coded = spark.createDataFrame(
        [(*row, "CAI") for row in numbered(PRODUCTS)],
        "id long, name string, sku string, manufacturer string, category string, warehouseCode string, "
        "locationCode string, minStock double, maxStock double, unitPrice double, uomCode string",
    )
    t["products"] = batch.resolve_products(coded, t["uoms"], t["warehouses"], t["locations"]).withColumn(
        "description", F.lit(None).cast("string")
    )
    t["customers"] = table(spark, schemas.CUSTOMERS, "id name code contactPerson phone", numbered(CUSTOMERS))
    t["transactions"] = resolved_entries(spark, t)
    t["invoices"] = table(spark, schemas.INVOICES, "id", [])
    t["invoice_items"] = table(spark, schemas.INVOICE_ITEMS, "id", [])
    t["maintenance_staff"] = table(spark, schemas.MAINTENANCE_STAFF, "id name code position specialty status", STAFF)
    t["maintenance_plans"] = table(
        spark, schemas.MAINTENANCE_PLANS,
        "id warehouseId title type priority plannedDate estimatedDuration estimatedCost responsibleStaff status", PLANS,
    )
    t["maintenance_progress"] = table(spark, schemas.MAINTENANCE_PROGRESS, "id", [])
    t["incidents"] = table(
        spark, schemas.INCIDENTS, "id warehouseId title type severity status resolvedBy", INCIDENTS
    )
    return t


def resolved_entries(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """Ledger rows; a transfer becomes an outbound leg at its warehouse and an inbound one at the target."""
    legs = []
    for kind, sku, code, *rest in ENTRIES:
        if kind == "transfer":
            target = "HCM001" if code == "HN001" else "DN001"
            legs += [("outbound", sku, code, *rest), ("inbound", sku, target, *rest)]
        else:
            legs.append((kind, sku, code, *rest))
    coded = spark.createDataFrame(
        numbered(legs),
        "id long, type string, sku string, warehouseCode string, quantity double, unitPrice double, supplier string, "
        "customer string, reference string, notes string",
    )
    keyed = batch.resolve_key(coded, t["products"], "sku", "sku", "productId")
    keyed = batch.resolve_key(keyed, t["warehouses"], "warehouseCode", "code", "warehouseId")
    keyed = keyed.withColumns({"locationId": F.lit(None).cast("long"), "transactionDate": F.lit(WHEN)})
    for name in ("createdAt", "updatedAt"):
        keyed = keyed.withColumn(name, F.lit(None).cast("timestamp"))
    return keyed.select(*[f.name for f in schemas.TRANSACTIONS])
