"""On-hand stock and movements, the aggregates below most reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from depotlens.functions.columns import line_value, of_type, signed_quantity
from depotlens.functions.numbers import PARTS, exact_sum, total_of, zero_if_null
from depotlens.plans.lookups import only_keys_of

Tables = Mapping[str, DataFrame]

#: What each movement column sums over ledger lines.
AMOUNTS: dict[str, Callable[[], Column]] = {
    "totalIn": lambda: of_type("inbound", F.col("quantity")),
    "totalOut": lambda: of_type("outbound", F.col("quantity")),
    "onHand": signed_quantity,
    "inValue": lambda: of_type("inbound", line_value()),
    "outValue": lambda: of_type("outbound", line_value()),
}


def is_partial(rows: DataFrame) -> bool:
    """Whether these are partial sums (``plans.snapshot``) and not ledger lines."""
    return "onHand" in rows.columns and isinstance(rows.schema["onHand"].dataType, StructType)


def _summed(rows: DataFrame, column: str) -> Column:
    if is_partial(rows):
        return F.sum("rows") if column == "rows" else total_of({p: F.sum(F.col(f"{column}.{p}")) for p in PARTS})
    return F.count("*") if column == "rows" else exact_sum(AMOUNTS[column]())


def movements(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Chosen movement columns per key, of ledger lines or partial sums; combined on the map side before the shuffle."""
    measures = [zero_if_null(_summed(rows, c)).alias(c) for c in columns]
    return rows.groupBy(*keys).agg(*measures)


def stock_source(tables: Tables) -> DataFrame:
    """Where movements over all time come from: the partial sums in ``stock_snapshot`` if there are any, else the ledger."""
    return tables["stock_snapshot"] if "stock_snapshot" in tables else tables["transactions"]


def on_hand_by_key(ledger: DataFrame) -> DataFrame:
    return movements(ledger, ("productId", "warehouseId"), ("onHand",))


def with_home_stock(
    products: DataFrame, ledger: DataFrame, columns: Sequence[str], warehouse: str = "warehouseId"
) -> DataFrame:
    """Products with the movements booked in their home warehouse (0.0 where none are).

    The ledger shrinks to one row per (product, warehouse) before it meets the products, and
    to rows of home warehouses before that when the products are few enough.
    """
    homes = products.select(F.col("id").alias("productId"), F.col(warehouse).alias("warehouseId"))
    at_home = only_keys_of(ledger, homes, ["productId", "warehouseId"])
    stock = movements(at_home, ("productId", "warehouseId"), columns).select(
        F.col("productId").alias("_product"), F.col("warehouseId").alias("_warehouse"), *columns
    )
    met = (F.col("id") == F.col("_product")) & (F.col(warehouse) == F.col("_warehouse"))
    joined = products.join(stock, met, "left").drop("_product", "_warehouse")
    return joined.fillna(0.0, subset=list(columns))
