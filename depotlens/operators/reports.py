"""Management reports over the stock ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.columns import (
    like_ascii,
    line_value,
    of_type,
    signed_quantity,
    starts_with_ascii,
    stock_status,
    where_equal,
)
from depotlens.functions.dates import in_days, in_days_if_both, last_days, period_label
from depotlens.functions.numbers import exact_avg, exact_multiple, exact_sum, exact_total, percent, ratio, zero_if_null
from depotlens.plans.fanout import repeats, with_child_count
from depotlens.plans.lookups import lookup, sorted_list
from depotlens.plans.stock import Tables, movements, stock_source, with_home_stock

def overview(tables: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row of system totals; the date range limits every ledger figure."""
    ledger = in_days_if_both(tables["transactions"], "transactionDate", start, end)
    # By day first: the number of days is then a plain count, not a distinct one.
    daily = ledger.groupBy(F.to_date("transactionDate").alias("day")).agg(
        F.count("*").alias("rows"),
        exact_sum(of_type("inbound", line_value())).alias("totalInboundValue"),
        exact_sum(of_type("outbound", line_value())).alias("totalOutboundValue"),
        exact_sum(of_type("inbound", F.col("quantity"))).alias("totalInboundQuantity"),
        exact_sum(of_type("outbound", F.col("quantity"))).alias("totalOutboundQuantity"),
    )
    sums = [c for c in daily.columns if c.startswith("total")]
    totals = daily.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("totalTransactions"),
        F.count("day").alias("activeDays"),
        *[zero_if_null(exact_total(F.col(c))).alias(c) for c in sums],
    )

    def row_count(table: str) -> Column:
        return tables[table].select(F.count("*")).scalar()

    return totals.select(
        row_count("warehouses").alias("totalWarehouses"),
        row_count("products").alias("totalProducts"),
        row_count("customers").alias("totalCustomers"),
        "*",
        (F.col("totalInboundValue") - F.col("totalOutboundValue")).alias("netInventoryValue"),
        (F.col("totalInboundQuantity") - F.col("totalOutboundQuantity")).alias("netInventoryQuantity"),
        percent(F.col("totalOutboundQuantity"), F.col("totalInboundQuantity")).alias("turnoverRate"),
    )


def _home_totals(tables: Tables, ledger: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per warehouse: its products and the sums of what they moved there."""
    home = with_home_stock(
        tables["products"].select("id", "warehouseId").filter(F.col("warehouseId").isNotNull()),
        ledger,
        columns,
    )
    return home.groupBy(F.col("warehouseId").alias("_home")).agg(
        F.count("*").alias("totalProducts"), *[exact_total(F.col(c)).alias(c) for c in columns]
    )


def inventory_by_warehouse(tables: Tables) -> DataFrame:
    """Stock of the products homed in each warehouse.

    ``netInventoryValue`` is inbound minus outbound quantity, as the original reports it.
    """
    columns = ("totalIn", "totalOut", "onHand", "inValue")
    totals = _home_totals(tables, stock_source(tables), columns)
    joined = tables["warehouses"].join(totals, F.col("id") == F.col("_home"), "left")
    joined = joined.fillna(0, subset=["totalProducts", *columns])
    return joined.select(
        "id",
        F.col("name").alias("warehouseName"),
        F.col("code").alias("warehouseCode"),
        "totalArea",
        "usedArea",
        "totalProducts",
        F.col("inValue").alias("totalInventoryValue"),
        F.col("totalIn").alias("totalInboundQuantity"),
        F.col("totalOut").alias("totalOutboundQuantity"),
        F.col("onHand").alias("onHandQuantity"),
        percent(F.col("usedArea"), F.col("totalArea")).alias("utilizationRate"),
        (F.col("totalIn") - F.col("totalOut")).alias("netInventoryValue"),
        F.col("onHand").alias("netInventoryQuantity"),
    ).orderBy("warehouseName", "id")


def _named_products(tables: Tables, products: DataFrame) -> DataFrame:
    products = lookup(products, tables["warehouses"], "warehouseId", warehouseName="name")
    return lookup(products, tables["locations"], "locationId", locationName="name")


def _product_head() -> list[Column]:
    name = F.col("name").alias("productName")
    rest = ("sku", "category", "manufacturer", "minStock", "maxStock", "unitPrice", "warehouseName", "locationName")
    return [F.col("id"), name, *map(F.col, rest)]


def inventory_by_product(
    tables: Tables,
    category: str | None = None,
    warehouse_id: int | None = None,
    stock_status_is: str | None = None,
) -> DataFrame:
    """Movements, stock and stock status of every product in its home warehouse."""
    products = where_equal(tables["products"], category=category, warehouseId=warehouse_id)
    stock = with_home_stock(products, stock_source(tables), ("totalIn", "totalOut", "onHand", "inValue"))
    # The status is worked out after the query, where a missing bound counts as 0.
    status = stock_status(
        F.col("onHand"), zero_if_null(F.col("minStock")), zero_if_null(F.col("maxStock"))
    )
    result = _named_products(tables, stock).select(
        *_product_head(),
        "totalIn",
        "totalOut",
        "onHand",
        F.col("inValue").alias("inventoryValue"),
        status.alias("stockStatus"),
    )
    return where_equal(result, stockStatus=stock_status_is).orderBy("productName", "id")


def transactions_timeline(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    type: str | None = None,
    warehouse_id: int | None = None,
) -> DataFrame:
    """Activity per day and type, newest day first."""
    ledger = where_equal(tables["transactions"], type=type, warehouseId=warehouse_id)
    ledger = in_days(ledger, "transactionDate", start, end)
    day = F.to_date("transactionDate").alias("date")
    # Two distinct counts in one aggregation would triple the rows and shuffle them by product
    # and warehouse, so products and warehouses are counted apart and meet by day and type.
    by_product = (
        ledger.groupBy(day, "type", "productId")
        .agg(
            F.count("*").alias("rows"),
            exact_sum(F.col("quantity")).alias("quantity"),
            exact_sum(line_value()).alias("value"),
        )
        .groupBy("date", "type")
        .agg(
            F.sum("rows").alias("transactionCount"),
            exact_total(F.col("quantity")).alias("totalQuantity"),
            exact_total(F.col("value")).alias("totalValue"),
            F.count("productId").alias("uniqueProducts"),
        )
    )
    by_warehouse = (
        ledger.select(day, "type", "warehouseId")
        .distinct()
        .groupBy(F.col("date").alias("_date"), F.col("type").alias("_type"))
        .agg(F.count("warehouseId").alias("uniqueWarehouses"))
    )
    same = F.col("date").eqNullSafe(F.col("_date")) & F.col("type").eqNullSafe(F.col("_type"))
    return by_product.join(by_warehouse, same).drop("_date", "_type").orderBy(F.desc("date"), "type")


def _referenced(
    tables: Tables, prefix: str, start: str | None, end: str | None, warehouse_id: int | None
) -> DataFrame:
    ledger = tables["transactions"].filter(starts_with_ascii("reference", prefix))
    return where_equal(in_days(ledger, "transactionDate", start, end), warehouseId=warehouse_id)


def transfer_report(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    from_warehouse_id: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Legs with a ``TR-`` reference folded into one row per transfer.

    Legs are taken newest first (ties by id). The head of the row is the first leg, the
    warehouses are those of the last outbound and inbound leg. Read in that order, a
    transfer is completed when an inbound leg comes last and its source is known, so the
    outbound leg has to be the newer one. The source filter keeps only legs booked in that
    warehouse, also inbound ones.
    """
    age = F.coalesce(-F.unix_micros(F.col("transactionDate").cast("timestamp")), F.lit(2**63 - 1))
    place = F.struct(age.alias("age"), F.col("id").alias("id"))
    out_leg, in_leg = F.col("type") == "outbound", F.col("type") == "inbound"
    head = F.struct(
        F.col("transactionDate").alias("date"), "productId", "quantity", "unitPrice", "notes", "id"
    )
    folded = (
        _referenced(tables, "TR-", start, end, from_warehouse_id)
        .groupBy("reference")
        .agg(
            F.min_by(head, place).alias("head"),
            F.max_by("warehouseId", F.when(out_leg, place)).alias("_from"),
            F.max_by("warehouseId", F.when(in_leg, place)).alias("_to"),
            F.max_by("type", F.when(out_leg | in_leg, place)).alias("_last"),
            F.bool_or(out_leg).alias("_left"),
        )
        .select("reference", "head.*", "_from", "_to", "_last", "_left")
    )
    named = lookup(folded, tables["products"], "productId", product="name", sku="sku")
    named = lookup(named, tables["warehouses"], "_from", fromWarehouse="name")
    named = lookup(named, tables["warehouses"], "_to", toWarehouse="name")
    source_known = F.coalesce(F.col("fromWarehouse") != "", F.lit(False))
    status = (
        F.when(F.col("_last").isNull(), "pending")
        .when(F.col("_last") == "outbound", "in_progress")
        .when(source_known, "completed")
        .when(F.col("_left"), "in_progress")
        .otherwise("pending")
    )
    return sorted_list(named, F.desc("date"), "id", ordered=ordered).select(
        "reference",
        "date",
        "product",
        "sku",
        "quantity",
        "unitPrice",
        "notes",
        "fromWarehouse",
        "toWarehouse",
        status.alias("status"),
    )


def _named_entries(tables: Tables, entries: DataFrame, ordered: bool) -> DataFrame:
    entries = lookup(entries, tables["products"], "productId", productName="name", sku="sku")
    entries = lookup(entries, tables["warehouses"], "warehouseId", warehouseName="name")
    entries = lookup(entries, tables["locations"], "locationId", locationName="name")
    return sorted_list(entries, F.desc("transactionDate"), "id", ordered=ordered)


ENTRY = (
    "id",
    "reference",
    "transactionDate",
    "quantity",
    "notes",
    "productName",
    "sku",
    "warehouseName",
    "locationName",
)


def adjustment_report(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    warehouse_id: int | None = None,
    reason: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Entries with an ``ADJ-`` reference, labelled by the sign of their quantity."""
    entries = _referenced(tables, "ADJ-", start, end, warehouse_id)
    if reason:
        entries = entries.filter(like_ascii("notes", reason))
    return _named_entries(tables, entries, ordered).select(
        *ENTRY,
        F.when(F.col("quantity") > 0, "Tăng").otherwise("Giảm").alias("adjustmentType"),
        F.abs(F.col("quantity")).alias("absoluteQuantity"),
    )


def stocktake_report(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    warehouse_id: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Entries with an ``ST-`` reference."""
    return _named_entries(tables, _referenced(tables, "ST-", start, end, warehouse_id), ordered).select(*ENTRY)


def revenue_timeline(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    warehouse_id: int | None = None,
    group_by: str = "day",
) -> DataFrame:
    """Outbound revenue per day, week (Monday-based, 00-53) or month."""
    sales = where_equal(tables["transactions"], type="outbound", warehouseId=warehouse_id)
    sales = in_days(sales, "transactionDate", start, end)
    return (
        sales.groupBy(period_label(F.col("transactionDate"), group_by).alias("period"))
        .agg(
            F.count("*").alias("transactionCount"),
            exact_sum(F.col("quantity")).alias("totalQuantity"),
            exact_sum(line_value()).alias("totalRevenue"),
            F.count_distinct("productId").alias("uniqueProducts"),
            exact_avg(line_value()).alias("averageOrderValue"),
        )
        .orderBy(F.desc("period"))
    )


TOP_PRODUCT_ORDER = {"quantity": "totalQuantity", "transactions": "transactionCount"}


def top_products(
    tables: Tables,
    start: str | None = None,
    end: str | None = None,
    warehouse_id: int | None = None,
    limit: int = 10,
    sort_by: str = "revenue",
) -> DataFrame:
    """Best-selling products per warehouse they were sold from.

    Products and warehouses are looked up after the sums by id; ids without a dimension
    row then fall into one group, which is why sums and counts are added up once more.
    """
    sales = where_equal(tables["transactions"], type="outbound", warehouseId=warehouse_id)
    by_id = (
        in_days(sales, "transactionDate", start, end)
        .groupBy("productId", "warehouseId")
        .agg(
            F.count("*").alias("n"),
            exact_sum(F.col("quantity")).alias("quantity"),
            exact_sum(line_value()).alias("revenue"),
            exact_sum(F.col("unitPrice")).alias("prices"),
            F.count("unitPrice").alias("priced"),
        )
    )
    named = lookup(
        by_id,
        tables["products"],
        "productId",
        id="id",
        productName="name",
        sku="sku",
        category="category",
        manufacturer="manufacturer",
    )
    named = lookup(named, tables["warehouses"], "warehouseId", _warehouse="id", warehouseName="name")
    order = TOP_PRODUCT_ORDER.get(sort_by, "totalRevenue")
    return (
        named.groupBy("id", "productName", "sku", "category", "manufacturer", "warehouseName", "_warehouse")
        .agg(
            F.sum("n").alias("transactionCount"),
            exact_total(F.col("quantity")).alias("totalQuantity"),
            exact_total(F.col("revenue")).alias("totalRevenue"),
            (exact_total(F.col("prices")) / F.sum("priced")).alias("averagePrice"),
        )
        .orderBy(F.desc(order), "id", "_warehouse")
        .limit(int(limit))
        .drop("_warehouse")
    )


def warehouse_activity(tables: Tables, ledger: DataFrame, mode: str) -> DataFrame:
    """Warehouses with child counts and in/out/transfer totals (see ``plans.fanout``)."""
    booked = ledger.groupBy(F.col("warehouseId").alias("_booked")).agg(
        F.count_if(F.col("type") == "inbound").alias("inCount"),
        F.count_if(F.col("type") == "outbound").alias("outCount"),
        F.count_if(F.col("type") == "transfer").alias("transferCount"),
        zero_if_null(exact_sum(of_type("inbound", F.col("quantity")))).alias("inQuantity"),
        zero_if_null(exact_sum(of_type("outbound", F.col("quantity")))).alias("outQuantity"),
        zero_if_null(exact_sum(of_type("inbound", line_value()))).alias("inValue"),
        zero_if_null(exact_sum(of_type("outbound", line_value()))).alias("outValue"),
    )
    counts, sums = ["inCount", "outCount", "transferCount"], ["inQuantity", "outQuantity", "inValue", "outValue"]
    parents = with_child_count(tables["warehouses"], tables["products"], "warehouseId", "totalProducts")
    parents = with_child_count(parents, tables["locations"], "warehouseId", "totalLocations")
    joined = parents.join(booked, F.col("id") == F.col("_booked"), "left").fillna(0, subset=counts + sums)
    factor = repeats(mode, "totalProducts", "totalLocations")
    return joined.withColumns(
        {c: F.col(c) * factor for c in counts} | {s: exact_multiple(F.col(s), factor) for s in sums}
    )


def _warehouse_head() -> list[Column]:
    named = (F.col("name").alias("warehouseName"), F.col("code").alias("warehouseCode"))
    return [F.col("id"), *named, F.col("totalArea"), F.col("usedArea")]


def warehouse_performance(
    tables: Tables, start: str | None = None, end: str | None = None, mode: str = "reference"
) -> DataFrame:
    """Activity of every warehouse in the range; warehouses without any stay, with zeros."""
    ledger = in_days_if_both(tables["transactions"], "transactionDate", start, end)
    return (
        warehouse_activity(tables, ledger, mode)
        .select(
            *_warehouse_head(),
            "totalProducts",
            "totalLocations",
            F.col("inCount").alias("inboundTransactions"),
            F.col("outCount").alias("outboundTransactions"),
            F.col("transferCount").alias("transferTransactions"),
            F.col("inQuantity").alias("totalInboundQuantity"),
            F.col("outQuantity").alias("totalOutboundQuantity"),
            F.col("inValue").alias("totalInboundValue"),
            F.col("outValue").alias("totalOutboundValue"),
            percent(F.col("usedArea"), F.col("totalArea")).alias("utilizationRate"),
            (F.col("inCount") + F.col("outCount") + F.col("transferCount")).alias("totalTransactions"),
            (F.col("inValue") - F.col("outValue")).alias("netInventoryValue"),
            percent(F.col("outQuantity"), F.col("inQuantity")).alias("turnoverRate"),
            (F.col("inQuantity") - F.col("outQuantity")).alias("netInventoryQuantity"),
        )
        .orderBy("warehouseName", "id")
    )


def warehouse_efficiency(
    tables: Tables, start: str | None = None, end: str | None = None, mode: str = "reference"
) -> DataFrame:
    """Turnover, and inbound value and products per square metre."""
    ledger = in_days_if_both(tables["transactions"], "transactionDate", start, end)
    return (
        warehouse_activity(tables, ledger, mode)
        .select(
            *_warehouse_head(),
            "totalProducts",
            "totalLocations",
            F.col("inCount").alias("inboundCount"),
            F.col("outCount").alias("outboundCount"),
            F.col("inQuantity").alias("inboundQuantity"),
            F.col("outQuantity").alias("outboundQuantity"),
            F.col("inValue").alias("inboundValue"),
            F.col("outValue").alias("outboundValue"),
            percent(F.col("usedArea"), F.col("totalArea")).alias("utilizationRate"),
            (F.col("inCount") + F.col("outCount")).alias("totalTransactions"),
            percent(F.col("outQuantity"), F.col("inQuantity")).alias("turnoverRate"),
            ratio(F.col("inValue"), F.col("totalArea")).alias("valueEfficiency"),
            ratio(F.col("totalProducts"), F.col("totalArea")).alias("productDensity"),
        )
        .orderBy("warehouseName", "id")
    )


TREND_METRICS = {"quantity": lambda: exact_sum(F.col("quantity")), "transactions": lambda: F.count("*").cast("double")}


def trends(tables: Tables, period: int = 30, metric: str = "revenue", as_of: str | None = None) -> DataFrame:
    """Daily value of the last ``period`` days with its change against the previous day present."""
    ledger = last_days(tables["transactions"], "transactionDate", period, as_of)
    value = TREND_METRICS.get(metric, lambda: exact_sum(line_value()))()
    daily = ledger.groupBy(F.to_date("transactionDate").alias("date")).agg(
        value.alias("value"),
        F.count("*").alias("transactionCount"),
        F.count_distinct("productId").alias("uniqueProducts"),
    )
    # One row per day by now, so the unpartitioned window holds about ``period`` rows.
    previous = zero_if_null(F.lag("value").over(Window.orderBy("date")))
    change = ratio(zero_if_null(F.col("value")) - F.col("_previous"), F.col("_previous"), 100.0)
    return (
        daily.withColumn("_previous", previous)
        .withColumn("change", change)
        .withColumn(
            "changeType",
            F.when(F.col("change") > 0, "increase").when(F.col("change") < 0, "decrease").otherwise("stable"),
        )
        .drop("_previous")
        .orderBy("date")
    )


def low_stock_alert(tables: Tables, warehouse_id: int | None = None, limit: int | None = 20) -> DataFrame:
    """Products at or below 1.5 times their minimum stock, emptiest first."""
    products = where_equal(tables["products"], warehouseId=warehouse_id)
    alarm = F.col("minStock") * F.lit(1.5)
    short = with_home_stock(products, stock_source(tables), ("onHand",)).filter(F.col("onHand") <= alarm)
    if limit is not None:
        short = short.orderBy("onHand", "id").limit(int(limit))
    shortage = F.col("minStock") - F.col("onHand")
    return (
        _named_products(tables, short)
        .select(
            *_product_head(),
            "onHand",
            F.when(F.col("onHand") <= F.col("minStock"), "critical").otherwise("warning").alias("alertLevel"),
            shortage.alias("shortage"),
            (shortage * zero_if_null(F.col("unitPrice"))).alias("shortageValue"),
        )
        .orderBy("onHand", "id")
    )


INVENTORY_COST_SHARE = 0.02


def storage_cost(
    tables: Tables, warehouse_id: int | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Monthly rent plus 2 % of the inbound value.

    With both dates given, warehouses whose own products have no ledger row in the range
    there are left out.
    """
    warehouses = where_equal(tables["warehouses"], id=warehouse_id)
    ledger = in_days_if_both(tables["transactions"], "transactionDate", start, end)
    columns = ("onHand", "inValue", "rows")
    totals = _home_totals(tables, ledger, columns).drop("totalProducts")
    joined = warehouses.join(totals, F.col("id") == F.col("_home"), "left").fillna(0, subset=list(columns))
    if start and end:
        joined = joined.filter(F.col("rows") > 0)
    area, rent = zero_if_null(F.col("totalArea")), zero_if_null(F.col("rentalPrice"))
    return (
        joined.withColumn("monthlyRent", area * rent)
        .withColumn("inventoryCost", F.col("inValue") * F.lit(INVENTORY_COST_SHARE))
        .withColumn("totalMonthlyCost", F.col("monthlyRent") + F.col("inventoryCost"))
        .select(
            *_warehouse_head(),
            "rentalPrice",
            F.col("inValue").alias("inventoryValue"),
            F.col("onHand").alias("totalQuantity"),
            percent(F.col("usedArea"), F.col("totalArea")).alias("utilizationRate"),
            "monthlyRent",
            "inventoryCost",
            "totalMonthlyCost",
            ratio(F.col("totalMonthlyCost"), F.col("totalArea")).alias("costPerSqm"),
        )
        .orderBy("warehouseName", "id")
    )
