"""The inventory tables as views over the synthetic order tables.

Deliberate edge cases: warehouse 0 has no area, warehouse 23 no products, warehouse 24 no
locations; some products have no home, some units do not exist; orders without lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.plans.parts import nest_children

# Declared so that reading a table needs no job for its schema.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _cases(column: Column, *values: str) -> Column:
    """values[0] for 0, values[1] for 1, ..., the last for all others."""
    chosen = F.when(column == 0, values[0])
    for number, value in enumerate(values[1:-1], 1):
        chosen = chosen.when(column == number, value)
    return chosen.otherwise(values[-1])


class SyntheticTables(Mapping[str, DataFrame]):
    """Builds a table when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.builders: dict[str, Callable[[], DataFrame]] = {
            name: getattr(self, name) for name in vars(type(self)) if not name.startswith("_") and name != "raw"
        }

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        return self.builders[name]()

    def __contains__(self, name: object) -> bool:
        return name in self.builders

    def __iter__(self) -> Iterator[str]:
        return iter(self.builders)

    def __len__(self) -> int:
        return len(self.builders)

    def warehouses(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id",
            "n_name AS name",
            "concat('W', n_nationkey) AS code",
            "CAST(n_nationkey * 100 AS DOUBLE) AS totalArea",
            "CAST(n_nationkey * (n_nationkey % 7) * 10 AS DOUBLE) AS usedArea",
            "CAST(50000 + 1000 * n_nationkey AS DOUBLE) AS rentalPrice",
            "CASE WHEN n_nationkey % 3 = 0 THEN 'cold' ELSE 'general' END AS type",
        )

    def locations(self) -> DataFrame:
        slots = self.raw("nation").filter("n_nationkey < 24").selectExpr("n_nationkey", "explode(sequence(0, 3)) AS slot")
        return slots.select(
            F.expr("CAST(n_nationkey * 4 + slot AS BIGINT)").alias("id"),
            F.expr("CAST(n_nationkey AS BIGINT)").alias("warehouseId"),
            F.expr("concat('L', slot)").alias("code"),
            F.expr("concat('Slot ', slot)").alias("name"),
            F.when(F.col("slot") < 2, "storage").otherwise("picking").alias("type"),
            F.expr("CAST(25 * (slot + 1) AS DOUBLE)").alias("area"),
            F.expr("CAST(40 * slot AS DOUBLE)").alias("capacity"),
            _cases(F.expr("(n_nationkey + slot) % 4"), "available", "occupied", "full", "maintenance").alias("status"),
        )

    def uoms(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "CAST(r_regionkey AS BIGINT) AS id", "r_name AS name", "concat('U', r_regionkey) AS code"
        )

    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS id",
            "p_name AS name",
            "concat('SKU-', p_partkey) AS sku",
            "concat(p_name, ' ', p_type) AS description",
            "p_type AS category",
            "p_brand AS manufacturer",
            "p_partkey % 6 AS uomId",
            "CASE WHEN p_partkey % 25 <> 23 THEN p_partkey % 25 END AS warehouseId",
            "CASE WHEN p_partkey % 25 < 23 THEN (p_partkey % 25) * 4 + (p_partkey div 25) % 3 END AS locationId",
            "CAST(p_size AS DOUBLE) / 2 AS minStock",
            "CAST(p_size AS DOUBLE) * 4 AS maxStock",
            "p_retailprice AS unitPrice",
        )

    def transactions(self) -> DataFrame:
        """The ledger without customer names, which only one operator needs."""
        return self._ledger(self.raw("lineitem"))

    def customer_ledger(self) -> DataFrame:
        """The ledger with the name of the customer whose order a row belongs to."""
        buyers = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        buyers = buyers.select("o_orderkey", "c_name")
        joined = self.raw("lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        return self._ledger(joined, "c_name AS customer")

    @staticmethod
    def _ledger(lines: DataFrame, *more: str) -> DataFrame:
        return lines.selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id",
            """CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 'inbound'
                    WHEN l_returnflag = 'N' THEN 'outbound'
                    WHEN l_linestatus = 'F' THEN 'transfer' ELSE 'adjustment' END AS type""",
            "l_partkey AS productId",
            "l_suppkey % 25 AS warehouseId",
            "CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 25 < 24 THEN (l_suppkey % 25) * 4 END AS locationId",
            "l_quantity AS quantity",
            "l_extendedprice / l_quantity AS unitPrice",
            """concat(CASE l_linenumber WHEN 1 THEN 'TR-' WHEN 2 THEN 'ADJ-' WHEN 3 THEN 'ST-' ELSE 'PO-' END,
                      l_orderkey) AS reference""",
            "l_returnflag AS notes",
            "l_shipdate AS transactionDate",
            *more,
        )

    def customers(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "c_name AS name",
            "concat('C-', c_custkey) AS code",
            "c_mktsegment AS contactPerson",
            "concat('09', c_custkey) AS phone",
            "concat('c', c_custkey, '@example.com') AS email",
            "c_acctbal AS creditLimit",
            "CASE WHEN c_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status",
        )

    def invoices(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "concat('INV-', o_orderkey) AS invoiceNumber",
            "o_custkey AS customerId",
            "CAST(o_orderdate AS DATE) AS invoiceDate",
            "o_totalprice AS total",
            "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS status",
        )

    def invoice_items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS invoiceId",
            "l_partkey AS productId",
            "l_linenumber AS lineNo",
            "l_quantity AS quantity",
            "l_extendedprice / l_quantity AS unitPrice",
            "l_extendedprice AS total",
        )

    def documents(self) -> DataFrame:
        """Heads of the stock slips; their lines are in ``document_lines``."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "CASE WHEN o_orderkey % 5 < 3 THEN 'IN' ELSE 'OUT' END AS type",
            "concat(CASE WHEN o_orderkey % 5 < 3 THEN 'PN-' ELSE 'PX-' END, o_orderkey) AS code",
            "o_orderkey % 25 AS warehouseId",
            "o_orderdate AS createdAt",
        )

    def document_lines(self) -> DataFrame:
        heads = self.documents().withColumnRenamed("id", "documentId").drop("code")
        lines = self.raw("lineitem").selectExpr("l_orderkey", "l_partkey AS productId", "l_quantity AS qty")
        return heads.join(lines, F.col("documentId") == F.col("l_orderkey")).drop("l_orderkey")

    def nested_documents(self) -> DataFrame:
        """Stock slips with nested lines, in parts of 10,000."""
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey", "l_partkey AS productId", "l_quantity AS qty", "l_suppkey", "l_linenumber"
        )
        spread = ["productId", "qty", "l_suppkey", "l_linenumber"]
        line = F.struct("productId", "qty")
        return nest_children(self.documents(), lines, "l_orderkey", line, "lines", spread, 10_000)

    def maintenance_plans(self) -> DataFrame:
        return self.raw("events").filter("event_type IN ('view', 'click')").selectExpr(
            "event_id AS id",
            "user_id % 25 AS warehouseId",
            "concat('Plan ', event_id) AS title",
            "CASE WHEN event_type = 'view' THEN 'preventive' ELSE 'corrective' END AS type",
            "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority",
            "CAST(ts AS DATE) AS plannedDate",
            "CAST(1 + event_id % 5 AS INT) AS estimatedDuration",
            "value AS estimatedCost",
            "concat('Staff ', user_id % 20) AS responsibleStaff",
            """CASE event_id % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress'
               WHEN 2 THEN 'completed' ELSE 'cancelled' END AS status""",
        )

    def maintenance_progress(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'purchase'").selectExpr(
            "event_id AS id",
            "event_id - event_id % 3 AS planId",
            """CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress'
               WHEN 2 THEN 'planned' ELSE 'cancelled' END AS status""",
            "CAST(event_id % 101 AS INT) AS progressPercent",
            "value AS actualCost",
            "concat('Staff ', user_id % 20) AS updatedBy",
            "ts AS updatedAt",
        )

    def incidents(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'error'").selectExpr(
            "event_id AS id",
            "user_id % 25 AS warehouseId",
            "concat('Incident ', event_id) AS title",
            "'equipment' AS type",
            "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity",
            "ts AS reportedAt",
            "CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'reported' END AS status",
            "CASE WHEN event_id % 2 = 0 THEN concat('Staff ', user_id % 25) END AS resolvedBy",
        )

    def maintenance_staff(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id % 30 AS id").distinct().selectExpr(
            "id",
            "concat('Staff ', id) AS name",
            "concat('MT-', id) AS code",
            "CASE WHEN id % 2 = 0 THEN 'Điện tử, Cơ khí' ELSE 'Hệ thống lạnh' END AS specialty",
            "CASE WHEN id < 28 THEN 'active' ELSE 'inactive' END AS status",
        )

    def skus(self) -> DataFrame:
        """Two per product; the first is the default, except for every third product."""
        sides = self.raw("part").selectExpr("p_partkey", "explode(array('a', 'b')) AS side")
        return sides.selectExpr(
            "concat(p_partkey, '-', side) AS id",
            "p_partkey AS productId",
            "concat('K', side, p_partkey) AS skuCode",
            "CASE WHEN p_partkey % 5 <> 0 THEN concat('893', p_partkey) ELSE '' END AS barcode",
            "side = 'a' AND p_partkey % 3 <> 0 AS isDefault",
        )

    def contracts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "concat('HD-', c_custkey) AS code",
            "concat('C-', c_custkey % 1000) AS customerCode",
            "c_name AS customerName",
            "c_acctbal AS value",
            "date_format(date_add(DATE '2024-01-01', CAST(c_custkey % 300 AS INT)), 'yyyy-MM-dd') AS startDate",
            "date_format(date_add(DATE '2024-06-01', CAST(c_custkey % 300 AS INT)), 'yyyy-MM-dd') AS endDate",
            "CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' ELSE 'pending' END AS status",
            "concat('Contract ', c_mktsegment) AS description",
        )

    def invoice_documents(self) -> DataFrame:
        buyers = self.raw("customer").selectExpr("c_custkey", "c_name")
        joined = self.raw("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
        return joined.selectExpr(
            "concat('INV-', o_orderkey) AS code",
            "concat('C-', o_custkey) AS customerCode",
            "c_name AS customerName",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'Nhập' ELSE 'Xuất' END AS type",
            "o_totalprice AS totalWithTax",
            "date_format(o_orderdate, 'yyyy-MM-dd') AS issueDate",
            "date_format(date_add(CAST(o_orderdate AS DATE), 30), 'yyyy-MM-dd') AS dueDate",
            "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS status",
            "concat('Order ', o_orderpriority) AS description",
        )
