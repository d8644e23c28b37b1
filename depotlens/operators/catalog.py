"""Products, warehouses and locations with their stock."""

from __future__ import annotations

from collections import ChainMap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import any_of, like_ascii, line_value, stock_status, where_equal
from depotlens.functions.dates import in_days
from depotlens.functions.numbers import exact_multiple, exact_sum, exact_total, percent, zero_if_null
from depotlens.operators.reports import warehouse_activity
from depotlens.plans.fanout import repeats, with_child_count
from depotlens.plans.lookups import lookup, only_keys_of
from depotlens.plans.stock import Tables, on_hand_by_key, stock_source, with_home_stock


def product_list(tables: Tables, id: int | None = None) -> DataFrame:
    """Products with the names of unit, warehouse and location."""
    products = where_equal(tables["products"], id=id)
    named = lookup(products, tables["uoms"], "uomId", uomName="name")
    named = lookup(named, tables["warehouses"], "warehouseId", warehouseName="name")
    named = lookup(named, tables["locations"], "locationId", locationName="name")
    return named.orderBy("name", "id")


PRODUCT_TEXT = ("name", "sku", "description", "manufacturer")


def product_search(tables: Tables, keyword: str) -> DataFrame:
    """Products whose name, SKU, description or manufacturer contains the keyword."""
    found = tables["products"].filter(any_of([like_ascii(c, keyword) for c in PRODUCT_TEXT]))
    return product_list(ChainMap({"products": found}, tables))


def product_stock(tables: Tables, id: int | None = None) -> DataFrame:
    """Movements and stock of products in an existing home warehouse."""
    products = where_equal(tables["products"], id=id).select(
        "id", "name", "sku", F.col("warehouseId").alias("_home"), F.col("locationId").alias("_place")
    )
    columns = ("totalIn", "totalOut", "onHand")
    stock = with_home_stock(products, stock_source(tables), columns, "_home")
    stock = lookup(stock, tables["warehouses"], "_home", warehouseId="id", warehouseName="name")
    stock = lookup(stock, tables["locations"], "_place", locationId="id", locationName="name")
    known = F.col("warehouseId").isNotNull()
    return stock.select(
        "id",
        "name",
        "sku",
        "warehouseId",
        "warehouseName",
        "locationId",
        "locationName",
        *[F.when(known, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in columns],
    )


def warehouse_products(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """All product columns with unit, location, movements, stock and stock status."""
    products = where_equal(tables["products"].filter(F.col("warehouseId").isNotNull()), warehouseId=warehouse_id)
    stock = with_home_stock(products, stock_source(tables), ("totalIn", "totalOut", "onHand"))
    named = lookup(stock, tables["uoms"], "uomId", uomName="name")
    named = lookup(named, tables["locations"], "locationId", locationName="name")
    status = stock_status(F.col("onHand"), F.col("minStock"), F.col("maxStock"))
    return named.withColumn("stockStatus", status).orderBy("name", "id")


def warehouse_stock(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Stock list of a warehouse (of all, with their id, when none is given)."""
    return warehouse_products(tables, warehouse_id).select(
        "warehouseId",
        "id",
        "name",
        "sku",
        "category",
        "minStock",
        "maxStock",
        "unitPrice",
        "locationName",
        "totalIn",
        "totalOut",
        "onHand",
        "stockStatus",
    )


def location_products(tables: Tables, id: int | None = None) -> DataFrame:
    """Products kept at a location with their movements and stock."""
    products = where_equal(tables["products"].filter(F.col("locationId").isNotNull()), locationId=id)
    stock = with_home_stock(products, stock_source(tables), ("totalIn", "totalOut", "onHand"))
    return lookup(stock, tables["uoms"], "uomId", uomName="name").orderBy("name", "id")


def _catalog_value(
    priced: DataFrame, ledger: DataFrame, group: str, warehouse: str, bounded_by: DataFrame | None = None
) -> DataFrame:
    """Per group: number of products and their stock in ``warehouse`` at catalog price."""
    held = priced.select(F.col("_id").alias("productId"), F.col(warehouse).alias("warehouseId"))
    at_place = only_keys_of(ledger, held, ["productId", "warehouseId"], bounded_by)
    stock = on_hand_by_key(at_place).select(
        F.col("productId").alias("_product"), F.col("warehouseId").alias("_warehouse"), "onHand"
    )
    met = (F.col("_id") == F.col("_product")) & (F.col(warehouse) == F.col("_warehouse"))
    value = F.col("unitPrice") * zero_if_null(F.col("onHand"))
    return (
        priced.join(stock, met, "left")
        .groupBy(F.col(group).alias("_group"))
        .agg(F.count("*").alias("productCount"), zero_if_null(exact_total(value)).alias("inventoryValue"))
    )


def warehouse_list(tables: Tables, id: int | None = None, mode: str = "reference") -> DataFrame:
    """Warehouses with location and product counts and stock value at catalog price.

    In reference mode the value is counted once per location. A look-up by id has no value.
    """
    warehouses = where_equal(tables["warehouses"], id=id)
    counted = with_child_count(warehouses, tables["locations"], "warehouseId", "totalLocations")
    if id is not None:
        return with_child_count(counted, tables["products"], "warehouseId", "totalProducts")
    priced = tables["products"].filter(F.col("warehouseId").isNotNull())
    priced = priced.select(F.col("id").alias("_id"), "warehouseId", "unitPrice")
    value = _catalog_value(priced, stock_source(tables), "warehouseId", "warehouseId")
    value = value.withColumnsRenamed({"productCount": "totalProducts", "inventoryValue": "totalInventoryValue"})
    joined = counted.join(value, F.col("id") == F.col("_group"), "left").drop("_group")
    joined = joined.fillna(0, subset=["totalProducts", "totalInventoryValue"])
    total = exact_multiple(F.col("totalInventoryValue"), repeats(mode, "totalLocations"))
    return joined.withColumn("totalInventoryValue", total).orderBy("name", "id")


def warehouse_stats(tables: Tables, id: int | None = None, mode: str = "reference") -> DataFrame:
    """In and out totals per warehouse, over the whole ledger."""
    ledger = where_equal(tables["transactions"], warehouseId=id)
    scoped = ChainMap({"warehouses": where_equal(tables["warehouses"], id=id)}, tables)
    return warehouse_activity(scoped, ledger, mode).select(
        "id",
        F.col("name").alias("warehouseName"),
        "totalArea",
        "usedArea",
        "totalLocations",
        "totalProducts",
        F.col("inQuantity").alias("totalInbound"),
        F.col("outQuantity").alias("totalOutbound"),
        F.col("inValue").alias("totalInboundValue"),
        F.col("outValue").alias("totalOutboundValue"),
        percent(F.col("usedArea"), F.col("totalArea")).alias("utilizationRate"),
        (F.col("inQuantity") - F.col("outQuantity")).alias("netInventory"),
        (F.col("inValue") - F.col("outValue")).alias("netValue"),
    )


def _valued_locations(tables: Tables, locations: DataFrame) -> DataFrame:
    """Locations with product count and value of those products in the location's warehouse."""
    places = locations.select(F.col("id").alias("_place"), F.col("warehouseId").alias("_at"))
    products = tables["products"].select(F.col("id").alias("_id"), "locationId", "unitPrice")
    # A product is at one location at most, so no more rows come out than products.
    priced = products.join(places, F.col("locationId") == F.col("_place"))
    value = _catalog_value(priced, stock_source(tables), "_place", "_at", products)
    joined = locations.join(value, F.col("id") == F.col("_group"), "left").drop("_group")
    return joined.fillna(0, subset=["productCount", "inventoryValue"])


def warehouse_locations(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Locations of a warehouse with product count and stock value."""
    locations = where_equal(tables["locations"].filter(F.col("warehouseId").isNotNull()), warehouseId=warehouse_id)
    return _valued_locations(tables, locations).orderBy("code", "id")


def location_list(
    tables: Tables,
    warehouse_id: int | None = None,
    type: str | None = None,
    status: str | None = None,
    id: int | None = None,
    with_value: bool = True,
) -> DataFrame:
    """Locations with warehouse, product count and stock value.

    The look-ups by id and by type show no value: pass ``with_value=False`` for them.
    """
    locations = where_equal(tables["locations"], warehouseId=warehouse_id, type=type, status=status, id=id)
    named = lookup(
        locations, tables["warehouses"], "warehouseId", warehouseName="name", warehouseCode="code"
    )
    if with_value:
        listed = _valued_locations(tables, named)
    else:
        listed = with_child_count(named, tables["products"], "locationId", "productCount")
    return listed.orderBy("warehouseName", "code", "id")


def warehouse_map(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Fill level of every location; a missing capacity counts as 0."""
    return warehouse_locations(tables, warehouse_id).select(
        "warehouseId",
        "id",
        "code",
        "name",
        "type",
        "area",
        "capacity",
        "status",
        "productCount",
        "inventoryValue",
        percent(F.col("productCount"), F.col("capacity")).alias("utilizationRate"),
        (zero_if_null(F.col("capacity")) - F.col("productCount")).alias("availableCapacity"),
    )


def available_locations(
    tables: Tables, warehouse_id: int | None = None, type: str | None = None, min_area: float | None = None
) -> DataFrame:
    """Available locations with free capacity, largest first."""
    locations = where_equal(tables["locations"], status="available", warehouseId=warehouse_id, type=type)
    if min_area:
        locations = locations.filter(F.col("area") >= F.lit(float(min_area)))
    listed = location_list(ChainMap({"locations": locations}, tables), with_value=False)
    free = F.col("capacity") - F.col("productCount")
    return (
        listed.withColumn("availableCapacity", free)
        .filter(F.col("availableCapacity") > 0)
        .orderBy(F.desc("availableCapacity"), "id")
    )


LOCATION_STATUSES = ("available", "occupied", "full", "maintenance")


def location_stats_by_warehouse(tables: Tables, mode: str = "reference") -> DataFrame:
    """Location counts by status, area and capacity per warehouse.

    In reference mode a location counts once per product it holds (once if empty).
    """
    locations = with_child_count(tables["locations"], tables["products"], "locationId", "products")
    weight = repeats(mode, "products")

    def weighted(condition: Column) -> Column:
        return F.sum(F.when(condition, weight).otherwise(F.lit(0)))

    stats = locations.groupBy(F.col("warehouseId").alias("_at")).agg(
        F.sum(weight).alias("totalLocations"),
        *[weighted(F.col("status") == s).alias(f"{s}Locations") for s in LOCATION_STATUSES],
        exact_total(F.col("area") * weight).alias("totalArea"),
        exact_total(F.col("capacity") * weight).alias("totalCapacity"),
        F.sum("products").alias("totalProducts"),
    )
    counts = ["totalLocations", *[f"{s}Locations" for s in LOCATION_STATUSES], "totalProducts"]
    head = tables["warehouses"].select(
        "id", F.col("name").alias("warehouseName"), F.col("code").alias("warehouseCode")
    )
    joined = head.join(stats, F.col("id") == F.col("_at"), "left").drop("_at").fillna(0, subset=counts)
    return (
        joined.withColumn("utilizationRate", percent(F.col("totalProducts"), F.col("totalCapacity")))
        .withColumn("availableCapacity", zero_if_null(F.col("totalCapacity")) - F.col("totalProducts"))
        .orderBy("warehouseName", "id")
    )


def warehouse_usage_report(
    tables: Tables, warehouse_id: int | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Activity of a warehouse per day and type."""
    ledger = tables["transactions"].filter(F.col("warehouseId").isNotNull())
    ledger = in_days(where_equal(ledger, warehouseId=warehouse_id), "transactionDate", start, end)
    return (
        ledger.groupBy("warehouseId", F.to_date("transactionDate").alias("date"), "type")
        .agg(
            F.count("*").alias("transactionCount"),
            exact_sum(F.col("quantity")).alias("totalQuantity"),
            exact_sum(line_value()).alias("totalValue"),
            F.count_distinct("productId").alias("uniqueProducts"),
        )
        .orderBy(F.desc("date"), "type", "warehouseId")
    )
