"""Lists and statistics straight from the stock ledger."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import line_value, of_type, where_equal
from depotlens.functions.dates import in_days, last_days
from depotlens.functions.numbers import exact_sum
from depotlens.plans.lookups import lookup, lookup_skewed, sorted_list
from depotlens.plans.stock import Tables, on_hand_by_key, stock_source


def ledger_list(
    tables: Tables,
    type: str | None = None,
    warehouse_id: int | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = 100,
    id: Any = None,
    ordered: bool = True,
    skewed: bool = False,
) -> DataFrame:
    """Newest ledger rows with the names of what they refer to.

    The limit is applied before the look-ups, which never change the number of rows. ``skewed`` looks products up
    by ``lookup_skewed``, for whole ledgers in which few products hold much of the rows.
    """
    ledger = where_equal(tables["transactions"], type=type, warehouseId=warehouse_id, id=id)
    ledger = in_days(ledger, "transactionDate", start, end)
    newest_first = (F.desc("transactionDate"), F.asc("id"))
    if limit is not None:
        ledger = ledger.orderBy(*newest_first).limit(int(limit))
    of_products = lookup_skewed if skewed else lookup
    named = of_products(ledger, tables["products"], "productId", productName="name", productSku="sku", _uom="uomId")
    named = lookup(named, tables["warehouses"], "warehouseId", warehouseName="name")
    named = lookup(named, tables["locations"], "locationId", locationName="name")
    named = lookup(named, tables["uoms"], "_uom", uomName="name").drop("_uom")
    return sorted_list(named, *newest_first, ordered=ordered)


def _in_out_sums(names: tuple[str, str, str, str]) -> list[Column]:
    in_quantity, out_quantity, in_value, out_value = names
    return [
        exact_sum(of_type("inbound", F.col("quantity"))).alias(in_quantity),
        exact_sum(of_type("outbound", F.col("quantity"))).alias(out_quantity),
        exact_sum(of_type("inbound", line_value())).alias(in_value),
        exact_sum(of_type("outbound", line_value())).alias(out_value),
    ]


def ledger_summary(
    tables: Tables, warehouse_id: int | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One row of counts by type and sums; the sums are NULL when no row is left."""
    ledger = where_equal(tables["transactions"], warehouseId=warehouse_id)
    return in_days(ledger, "transactionDate", start, end).agg(
        F.count("*").alias("totalTransactions"),
        F.count_if(F.col("type") == "inbound").alias("totalInbound"),
        F.count_if(F.col("type") == "outbound").alias("totalOutbound"),
        F.count_if(F.col("type") == "transfer").alias("totalTransfer"),
        F.count_if(F.col("type") == "adjustment").alias("totalAdjustment"),
        *_in_out_sums(("totalInQuantity", "totalOutQuantity", "totalInValue", "totalOutValue")),
    )


def ledger_daily(
    tables: Tables, warehouse_id: int | None = None, days: int = 30, as_of: str | None = None
) -> DataFrame:
    """Per day of the last ``days`` days: rows, quantities and values in and out."""
    # "now" belongs to the whole ledger, whichever warehouse is asked for.
    ledger = last_days(tables["transactions"], "transactionDate", days, as_of)
    return (
        where_equal(ledger, warehouseId=warehouse_id)
        .groupBy(F.to_date("transactionDate").alias("date"))
        .agg(
            F.count("*").alias("totalTransactions"),
            *_in_out_sums(("inboundQuantity", "outboundQuantity", "inboundValue", "outboundValue")),
        )
        .orderBy(F.desc("date"))
    )


def on_hand(tables: Tables, product_id: int | None = None, warehouse_id: int | None = None) -> DataFrame:
    """Signed stock per product and warehouse."""
    rows = where_equal(stock_source(tables), productId=product_id, warehouseId=warehouse_id)
    return on_hand_by_key(rows)
