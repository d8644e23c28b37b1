"""Dashboard figures over stock slips ("documents": one IN or OUT slip with nested lines).

``tables["documents"]`` holds the slips. Their lines come from ``tables["document_lines"]``
when that is given flat, else from exploding ``documents.lines``. Amounts use the catalog
price of the product, 0 when the product is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import or_default
from depotlens.functions.dates import day_spine, newest
from depotlens.functions.numbers import exact_sum, exact_total, round_half_up, zero_if_null
from depotlens.plans.lookups import lookup
from depotlens.plans.parts import heads
from depotlens.plans.stock import Tables

LOW_STOCK = 5.0


def document_lines(tables: Tables) -> DataFrame:
    """One row per slip line: documentId, type, warehouseId, createdAt, productId, qty."""
    if "document_lines" in tables:
        return tables["document_lines"]
    head = (F.col("id").alias("documentId"), "type", "warehouseId", "createdAt")
    return tables["documents"].select(*head, F.explode("lines").alias("line")).select(
        *("documentId", "type", "warehouseId", "createdAt"), "line.productId", "line.qty"
    )


def signed_qty() -> Column:
    return F.when(F.col("type") == "IN", F.col("qty")).otherwise(-F.col("qty"))


def moved_qty(kind: str) -> Column:
    """Quantity of IN slips, or of all others (which count as OUT)."""
    return F.when(F.col("type").eqNullSafe("IN") == F.lit(kind == "IN"), F.col("qty")).otherwise(F.lit(0.0))


def document_on_hand(tables: Tables, warehouse_id: str | int | None = None) -> DataFrame:
    """Every product with its stock over all slips (of one warehouse, if given)."""
    lines = document_lines(tables)
    if warehouse_id is not None:
        lines = lines.filter(F.col("warehouseId") == F.lit(warehouse_id))
    stock = lines.groupBy(F.col("productId").alias("_product")).agg(exact_sum(signed_qty()).alias("onHand"))
    joined = tables["products"].join(stock, F.col("id") == F.col("_product"), "left").drop("_product")
    return joined.fillna(0.0, subset=["onHand"])


def free_area() -> Column:
    return F.col("totalArea") - F.col("usedArea")


def dashboard_kpis(tables: Tables, as_of: str | None = None) -> DataFrame:
    """One row: products, low stock, slips of the day, free area, sum of catalog prices."""
    documents = heads(tables["documents"])
    today = F.to_date(newest(documents, "createdAt", as_of))
    slips = documents.filter((F.col("createdAt") >= today) & (F.col("createdAt") < F.date_add(today, 1)))
    stock = document_on_hand(tables).agg(
        F.count("*").alias("products"),
        F.count_if(F.col("onHand") <= LOW_STOCK).alias("lowStock"),
        zero_if_null(exact_sum(F.col("unitPrice"))).alias("catalogValue"),
    )
    area = tables["warehouses"].select(zero_if_null(exact_sum(zero_if_null(free_area())))).scalar()

    def slip_count(kind: str) -> Column:
        # Both counts are over the same rows, so that Spark merges them into one scan.
        return slips.select(F.count_if(F.col("type") == kind)).scalar()

    return stock.select(
        "products",
        "lowStock",
        slip_count("IN").alias("inToday"),
        slip_count("OUT").alias("outToday"),
        area.alias("freeArea"),
        "catalogValue",
    )


def in_out_last_days(tables: Tables, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Number of IN and OUT slips for each of the last days, zero-filled."""
    documents = heads(tables["documents"])
    spine = day_spine(documents, "createdAt", days, as_of)
    day = F.to_date(newest(documents, "createdAt", as_of))
    per_day = (
        documents.filter(F.col("createdAt") >= F.date_sub(day, int(days) - 1))
        .groupBy(F.to_date("createdAt").alias("_day"))
        .agg(
            F.count_if(F.col("type") == "IN").alias("inCount"),
            F.count_if(F.col("type") == "OUT").alias("outCount"),
        )
    )
    joined = spine.join(per_day, F.col("date") == F.col("_day"), "left").drop("_day")
    return joined.fillna(0, subset=["inCount", "outCount"]).orderBy("date")


def top_on_hand(tables: Tables, limit: int = 5) -> DataFrame:
    """Products with the most stock over all warehouses."""
    stock = document_on_hand(tables).orderBy(F.desc("onHand"), "id").limit(int(limit))
    return stock.select("id", F.col("sku").alias("code"), "onHand").orderBy(F.desc("onHand"), "id")


def top_moved(
    tables: Tables, type: str = "IN", days: int = 30, limit: int = 5, as_of: str | None = None
) -> DataFrame:
    """Products with the largest moved quantity of one slip type in the last days.

    The window is ``days - 1`` times 24 hours back from ``as_of``; later slips count too.
    """
    lines = document_lines(tables)
    since = newest(tables["documents"], "createdAt", as_of) - F.make_dt_interval(F.lit(int(days) - 1))
    moved = (
        lines.filter((F.col("type") == type) & (F.col("createdAt") >= since))
        .groupBy("productId")
        .agg(exact_sum(F.col("qty")).alias("quantity"))
        .orderBy(F.desc("quantity"), "productId")
        .limit(int(limit))
    )
    named = lookup(moved, tables["products"], "productId", code="sku")
    return named.withColumn("code", F.coalesce("code", F.lit("?"))).orderBy(F.desc("quantity"), "productId")


def _priced(tables: Tables, per_product: DataFrame) -> DataFrame:
    """Adds the catalog price to rows that are already summed per product."""
    priced = lookup(per_product, tables["products"], "productId", price="unitPrice")
    return priced.withColumn("price", zero_if_null(F.col("price")))


def signed_value_trend(tables: Tables, days: int = 30, as_of: str | None = None) -> DataFrame:
    """Value moved in minus value moved out for each of the last days, zero-filled."""
    documents = tables["documents"]
    spine = day_spine(documents, "createdAt", days, as_of)
    first = F.date_sub(F.to_date(newest(documents, "createdAt", as_of)), int(days) - 1)
    net = (
        document_lines(tables)
        .filter(F.col("createdAt") >= first)
        .groupBy(F.to_date("createdAt").alias("_day"), "productId")
        .agg(exact_sum(signed_qty()).alias("net"))
    )
    per_day = _priced(tables, net).groupBy("_day").agg(exact_total(F.col("net") * F.col("price")).alias("value"))
    joined = spine.join(per_day, F.col("date") == F.col("_day"), "left").drop("_day")
    return joined.fillna(0.0, subset=["value"]).orderBy("date")


def area_utilization(tables: Tables) -> DataFrame:
    """One row: used and free area of all warehouses."""
    free = zero_if_null(free_area())
    used = F.greatest(F.lit(0.0), zero_if_null(F.col("totalArea")) - free)
    return tables["warehouses"].agg(
        zero_if_null(exact_sum(used)).alias("usedArea"), zero_if_null(exact_sum(free)).alias("freeArea")
    )


def free_area_by_warehouse(tables: Tables) -> DataFrame:
    """Free area per warehouse; all of it when the used area is unknown."""
    total = F.greatest(F.lit(0.0), zero_if_null(F.col("totalArea")))
    return tables["warehouses"].select("id", "code", F.coalesce(free_area(), total).alias("freeArea")).orderBy("id")


def low_stock_share(tables: Tables, threshold: float = LOW_STOCK) -> DataFrame:
    """One row: how many products are at or below the threshold, and how many above."""
    low = F.col("onHand") <= F.lit(float(threshold))
    return document_on_hand(tables).agg(
        F.count_if(low).alias("lowCount"), F.count_if(~low).alias("okCount")
    )


def _sold(tables: Tables, *keys: str) -> DataFrame:
    """OUT quantity per product and further keys, with the catalog price."""
    sold = document_lines(tables).filter(F.col("type") == "OUT")
    return _priced(tables, sold.groupBy("productId", *keys).agg(exact_sum(F.col("qty")).alias("qty")))


def revenue_by_warehouse(tables: Tables) -> DataFrame:
    """OUT value of every warehouse, rounded to whole units; 0 where nothing was sold."""
    sold = _sold(tables, "warehouseId")
    revenue = sold.groupBy(F.col("warehouseId").alias("_at")).agg(
        exact_total(F.col("qty") * F.col("price")).alias("revenue")
    )
    joined = tables["warehouses"].join(revenue, F.col("id") == F.col("_at"), "left")
    return joined.select(
        "id", "code", round_half_up(zero_if_null(F.col("revenue"))).alias("revenue")
    ).orderBy("id")


def revenue_by_group(tables: Tables, code_column: str = "sku") -> DataFrame:
    """OUT value by the first two letters of the product code, ``X`` for unknown products."""
    coded = lookup(_sold(tables), tables["products"], "productId", code=code_column)
    group = F.substring(or_default(F.col("code"), "X"), 1, 2)
    revenue = exact_total(F.col("qty") * F.col("price"))
    return coded.groupBy(group.alias("productGroup")).agg(revenue.alias("revenue")).orderBy("productGroup")


def movement_report(
    tables: Tables,
    warehouse_id: str | int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """In, out and balance of every product within a range of moments.

    ``end`` is a moment, so a plain date excludes all but midnight of that day.
    """
    lines = document_lines(tables)
    if warehouse_id is not None:
        lines = lines.filter(F.col("warehouseId") == F.lit(warehouse_id))
    if start:
        lines = lines.filter(F.col("createdAt") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        lines = lines.filter(F.col("createdAt") <= F.lit(end).cast("timestamp_ntz"))
    moved = lines.groupBy(F.col("productId").alias("_product")).agg(
        exact_sum(moved_qty("IN")).alias("inQty"), exact_sum(moved_qty("OUT")).alias("outQty")
    )
    joined = tables["products"].join(moved, F.col("id") == F.col("_product"), "left")
    return (
        joined.fillna(0.0, subset=["inQty", "outQty"])
        .select(
            "id",
            F.col("sku").alias("code"),
            "name",
            "inQty",
            "outQty",
            (F.col("inQty") - F.col("outQty")).alias("balance"),
        )
        .orderBy("id")
    )


def stocktake_variance(
    tables: Tables, counts: DataFrame | None = None, warehouse_id: str | int | None = None
) -> DataFrame:
    """System stock against counted stock; products not counted are taken as right."""
    stock = document_on_hand(tables, warehouse_id).select(
        F.col("id").alias("productId"), F.col("onHand").alias("systemQty")
    )
    if counts is None:
        counted = stock.withColumn("countedQty", F.col("systemQty"))
    else:
        sheet = counts.select(F.col("productId").alias("_product"), F.col("countedQty").cast("double"))
        counted = stock.join(sheet, F.col("productId") == F.col("_product"), "left").drop("_product")
        counted = counted.withColumn("countedQty", F.coalesce("countedQty", "systemQty"))
    return counted.withColumn("difference", F.col("countedQty") - F.col("systemQty")).orderBy("productId")


def rent_quote(tables: Tables, requests: DataFrame) -> DataFrame:
    """Rent of an area (default 0) for some months (default 1) at the warehouse's price."""
    asked = requests.select(
        "warehouseId",
        zero_if_null(F.col("area").cast("double")).alias("area"),
        F.coalesce(F.col("months").cast("double"), F.lit(1.0)).alias("months"),
    )
    quoted = lookup(asked, tables["warehouses"], "warehouseId", unitPrice="rentalPrice")
    price = zero_if_null(F.col("unitPrice"))
    return quoted.select(
        "warehouseId",
        price.alias("unitPrice"),
        "area",
        "months",
        (price * F.col("area") * F.col("months")).alias("total"),
    )


DEFAULT_WAREHOUSE_TYPE = "Thường"


def reprice(tables: Tables, percentage: float, target_type: str | None = None) -> DataFrame:
    """Warehouses with a changed rent price: those of one type, or all."""
    chosen = F.lit(True)
    if target_type:
        chosen = or_default(F.col("type"), DEFAULT_WAREHOUSE_TYPE) == target_type
    raised = round_half_up(zero_if_null(F.col("rentalPrice")) * F.lit(1 + float(percentage) / 100))
    return tables["warehouses"].withColumn(
        "rentalPrice", F.when(chosen, raised).otherwise(F.col("rentalPrice"))
    )


CARD_DEFAULTS = {
    # Fixed values of the product card.
    "uom": "Cái",
    "manufacturer": "Công ty TNHH ABC",
    "description": "Sản phẩm chất lượng cao",
}


def product_card(tables: Tables, last_updated: str) -> DataFrame:
    """JSON text per product for its label: default SKU, stock (never below 0), master data."""
    default_sku = (
        tables["skus"]
        .filter("isDefault")
        .groupBy(F.col("productId").alias("_product"))
        .agg(F.min_by(F.struct("skuCode", F.col("barcode").alias("skuBarcode")), "id").alias("sku_"))
        .select("_product", "sku_.*")
    )
    stocked = document_on_hand(tables)
    optional = {c: F.col(c) if c in stocked.columns else F.lit(None).cast("string") for c in
                ("uom", "barcode", "manufacturer", "description")}
    stocked = stocked.withColumns(optional)
    joined = stocked.join(default_sku, F.col("id") == F.col("_product"), "left")
    barcode = F.coalesce(or_default(F.col("skuBarcode"), None), or_default(F.col("barcode"), ""))
    card = F.struct(
        "id",
        F.col("sku").alias("code"),
        "name",
        or_default(F.col("uom"), CARD_DEFAULTS["uom"]).alias("uom"),
        barcode.alias("barcode"),
        or_default(F.col("skuCode"), "").alias("sku"),
        or_default(F.col("manufacturer"), CARD_DEFAULTS["manufacturer"]).alias("manufacturer"),
        F.greatest(F.lit(0.0), F.col("onHand")).alias("onHand"),
        F.lit(last_updated).alias("lastUpdated"),
        or_default(F.col("description"), CARD_DEFAULTS["description"]).alias("description"),
    )
    return joined.select(F.col("id").alias("productId"), F.to_json(card).alias("card")).orderBy("productId")


# Slips of the browser use capital statuses, the server's plans say planned/in_progress.
LOCATION_STATUS_COUNTS = {
    "availableLocations": ("AVAILABLE",),
    "occupiedLocations": ("OCCUPIED",),
    "fullLocations": ("FULL",),
}
PLAN_STATUS_COUNTS = {
    "pendingMaintenance": ("PENDING", "PLANNED"),
    "inProgressMaintenance": ("INPROGRESS",),
    "completedMaintenance": ("COMPLETED",),
}


def _status_counts(df: DataFrame, total: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    status = F.replace(F.upper("status"), F.lit("_"), F.lit(""))
    return df.agg(
        F.count("*").alias(total), *[F.count_if(status.isin(*values)).alias(c) for c, values in wanted.items()]
    )


def location_status_counts(tables: Tables) -> DataFrame:
    """One row: locations in all and by status."""
    return _status_counts(tables["locations"], "totalLocations", LOCATION_STATUS_COUNTS)


def plan_status_counts(tables: Tables) -> DataFrame:
    """One row: maintenance plans in all and by status."""
    return _status_counts(tables["maintenance_plans"], "totalMaintenance", PLAN_STATUS_COUNTS)
