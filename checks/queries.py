"""Every operator as a query over the synthetic tables.

``(spark, folder) -> DataFrame``. Results are made portable between engines: dates and
timestamps become text.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.synthetic import SyntheticTables
from depotlens.operators import batch, billing, catalog, dashboard, ledger, maintenance, posting, reports, search, versions
from depotlens.plans import buckets, distinct, search_index, snapshot
from depotlens.plans.durable import new_path
from depotlens.sources import files

YEAR = {"start": "1996-01-01", "end": "1996-12-31"}
WEEK = {"start": "1996-01-01", "end": "1996-01-07"}


def portable(df: DataFrame) -> DataFrame:
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DateType):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(changed) if changed else df


def _outcomes(accepted: DataFrame, rejected: DataFrame, key: str = "id") -> DataFrame:
    return accepted.select(key, F.lit("accepted").alias("outcome")).unionByName(
        rejected.select(key, F.lit("rejected").alias("outcome"))
    )


def _top_products(t: SyntheticTables, **params: object) -> DataFrame:
    """A mean of quotients, the only sum of amounts that are not decimal, is rounded."""
    return reports.top_products(t, **params).withColumn("averagePrice", F.round("averagePrice", 6))


def invoice_document(t: SyntheticTables, operator: Callable[..., DataFrame] = billing.invoice_document) -> DataFrame:
    """The nested items as text, since engines print nested values differently."""
    document = operator(t)
    line = F.transform(
        "items",
        lambda i: F.concat_ws(
            ":", i["productId"], i["lineNo"], i["quantity"].cast("bigint"), i["total"].cast("decimal(18,2)"), i["productSku"]
        ),
    )
    return document.select(
        "id", "invoiceNumber", "customerName", "customerCode", "part", F.col("itemCount").cast("int").alias("itemCount"),
        F.array_join(line, "|").alias("items"),
    )


def validate_products(t: SyntheticTables) -> DataFrame:
    incoming = t["part"].selectExpr(
        "p_partkey AS id",
        "CASE WHEN p_size % 7 <> 0 THEN p_name ELSE '' END AS name",
        "CASE WHEN p_size % 11 <> 0 THEN concat('SKU-', p_partkey) END AS sku",
    )
    accepted, rejected = batch.validate_batch(incoming, "products")
    return accepted.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected)


def validate_transactions(t: SyntheticTables) -> DataFrame:
    incoming = t["transactions"].withColumns(
        {
            "type": F.when(F.col("quantity") > 40, F.lit("loan")).otherwise(F.col("type")),
            "quantity": F.when(F.col("quantity") <= 3, F.lit(0.0)).otherwise(F.col("quantity")),
        }
    )
    accepted, rejected = batch.validate_batch(incoming, "transactions")
    return accepted.withColumn("reject_reason", F.lit("")).unionByName(rejected).select("id", "reject_reason")


def reject_duplicates(t: SyntheticTables) -> DataFrame:
    incoming = t["part"].selectExpr("p_partkey AS id", "concat('SKU-', p_partkey % 5 + p_size * 1000) AS sku")
    return _outcomes(*batch.reject_duplicates(incoming, t["products"], "sku"))


def _stock_and_requests(t: SyntheticTables) -> tuple[DataFrame, DataFrame]:
    requested = F.col("type").isin("outbound", "transfer")
    return t["transactions"].filter(~requested), t["transactions"].filter(requested)


def post_outbound(t: SyntheticTables) -> DataFrame:
    stock, requests = _stock_and_requests(t)
    return posting.decide(requests, stock).select("id", "available", "accepted")


def post_outbound_rejected(t: SyntheticTables) -> DataFrame:
    stock, requests = _stock_and_requests(t)
    _, rejected = posting.post_outbound(requests, stock)
    return rejected.select("id", "available", "requested")


def post_outbound_blanks(t: SyntheticTables) -> DataFrame:
    """Requests without quantity, with none at all or without a date, which is then the last day."""
    stock, requests = _stock_and_requests(t)
    quantity, date = F.col("quantity"), F.col("transactionDate")
    requests = requests.withColumns(
        {
            "quantity": F.when(quantity > 3, quantity).when(quantity > 2, F.lit(0.0)),
            "transactionDate": F.when(~F.col("id").endswith("7"), date),
        }
    )
    posted, rejected = posting.post_outbound(requests, stock, now=datetime(2024, 1, 1))
    accepted = posted.withColumn("reject_reason", F.lit("")).select("id", "quantity", "transactionDate", "reject_reason")
    return accepted.unionByName(rejected.select("id", "quantity", "transactionDate", "reject_reason"))


def expand_transfers(t: SyntheticTables) -> DataFrame:
    requests = t["lineitem"].filter("l_returnflag = 'R' AND l_linestatus = 'F'").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id",
        "l_partkey AS productId",
        "l_suppkey % 25 AS fromWarehouseId",
        "(l_suppkey + l_linenumber) % 25 AS toWarehouseId",
        "CAST(NULL AS BIGINT) AS fromLocationId",
        "CAST(NULL AS BIGINT) AS toLocationId",
        "l_quantity AS quantity",
        "0.0D AS unitPrice",
        "concat('TR-', l_orderkey) AS reference",
        "l_returnflag AS notes",
        "l_shipdate AS transferDate",
    )
    stock = t["transactions"].filter("type <> 'transfer'")
    legs, rejected = posting.expand_transfers(requests, stock)
    return legs.select("id", "type", "productId", "warehouseId", "quantity").unionByName(
        rejected.select("id", F.lit("rejected").alias("type"), "productId",
                        F.col("fromWarehouseId").alias("warehouseId"), F.col("available").alias("quantity"))
    )


def expand_adjustments(t: SyntheticTables) -> DataFrame:
    requests = t["transactions"].filter("type = 'adjustment'").withColumns(
        {
            "quantity": F.when(F.col("notes") == "A", F.col("quantity")).otherwise(-F.col("quantity")),
            "reason": F.col("notes"),
            "adjustmentDate": F.col("transactionDate"),
        }
    )
    posted, rejected = posting.expand_adjustments(requests)
    told = rejected.select(
        "id",
        F.lit("rejected").alias("type"),
        *("productId", "warehouseId", "locationId", "quantity", "notes"),
        F.col("reject_reason").alias("reference"),
        F.col("adjustmentDate").alias("transactionDate"),
    )
    return posted.unionByName(told, allowMissingColumns=True)


def _product_changes(t: SyntheticTables) -> tuple[DataFrame, DataFrame]:
    """Products, and changes of known and unknown ones, some without a name."""
    changes = t["lineitem"].selectExpr(
        "l_partkey * 2 AS id",
        "CASE WHEN l_linenumber % 3 > 0 THEN concat('Version ', l_orderkey) ELSE '' END AS name",
        "concat('SKU-', l_partkey * 2) AS sku",
        "l_extendedprice AS unitPrice",
        "l_shipdate AS updatedAt",
    )
    return t["products"].withColumn("updatedAt", F.lit("1990-01-01").cast("timestamp_ntz")), changes


def _upserted(t: SyntheticTables, insert: bool) -> tuple[DataFrame, DataFrame]:
    return batch.upsert_latest(*_product_changes(t), "products", insert)


def upsert_latest_rejected(t: SyntheticTables) -> DataFrame:
    return _upserted(t, False)[1].select("id", "name", "sku", "unitPrice", "reject_reason")


def _updated_invoices(t: SyntheticTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents for known and unknown invoices, some without a number, some with that of another one."""
    documents = t["orders"].selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS id",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN concat('INV-', o_orderkey - 1) ELSE concat('UPD-', o_orderkey) END AS invoiceNumber",
        "o_custkey + 1 AS customerId",
        "CAST(o_orderdate AS DATE) AS invoiceDate",
        "CASE WHEN o_custkey % 2 = 0 THEN 8.0D END AS taxRate",
        """array(named_struct('productId', o_custkey, 'quantity', 2.0D, 'unitPrice', o_totalprice),
                 named_struct('productId', o_custkey + 1, 'quantity', 3.0D, 'unitPrice', 10.25D)) AS items""",
    )
    invoices = t["invoices"].withColumns({"subtotal": F.lit(0.0), "taxRate": F.lit(5.0), "taxAmount": F.lit(0.0)})
    return batch.update_invoices(invoices, t["invoice_items"], documents)


def _taxed(t: SyntheticTables) -> DataFrame:
    return t["invoices"].withColumns({c: F.lit(0.0) for c in ("subtotal", "taxAmount")} | {"taxRate": F.lit(8.0)})


def _replaced(t: SyntheticTables) -> tuple[DataFrame, DataFrame]:
    new_items = t["invoice_items"].filter("lineNo <= 2").drop("total")
    return batch.replace_children(_taxed(t), t["invoice_items"], new_items)


def _deleted(t: SyntheticTables, entity: str) -> DataFrame:
    kept, rejected = batch.guarded_delete(t, entity, t[entity])
    counts = [c for c in rejected.columns if c != "id"]
    held = rejected.select("id", F.concat_ws(",", *counts).alias("held_by"))
    return kept.select("id").join(held, "id", "left")


def _posted_invoices(t: SyntheticTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = t["lineitem"].selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id",
        "concat('NEW-', l_orderkey, '-', l_linenumber) AS invoiceNumber",
        "l_suppkey AS customerId",
        "CAST(l_shipdate AS DATE) AS invoiceDate",
        "CASE WHEN l_tax > 0.04 THEN 8.0D END AS taxRate",
        """array(named_struct('productId', l_partkey, 'quantity', l_quantity, 'unitPrice', 10.25D),
                 named_struct('productId', l_partkey + 1, 'quantity', 2.0D, 'unitPrice', l_extendedprice)) AS items""",
    )
    return batch.post_invoices(documents)


def upsert_area_usage(t: SyntheticTables) -> DataFrame:
    """Every ledger row reports the used area of its warehouse; the newest report counts."""
    reported = t["transactions"].select(
        F.col("warehouseId").alias("id"), F.col("quantity").alias("usedArea"), F.col("transactionDate").alias("updatedAt")
    )
    accepted, _ = batch.validate_batch(reported, "area_usage")
    target = t["warehouses"].withColumn("updatedAt", F.lit("1990-01-01").cast("timestamp_ntz"))
    return batch.upsert_latest(target, accepted, "area_usage")[0]


def plain_delete(t: SyntheticTables) -> tuple[DataFrame, DataFrame]:
    """Adjustments go; ids of requests that were never posted are unknown."""
    adjustments = t["transactions"].filter("type = 'adjustment'").select("id")
    never = t["transactions"].filter("type = 'transfer'").select(F.concat("id", F.lit("-x")).alias("id"))
    return batch.plain_delete(t["transactions"], adjustments.unionByName(never))


def _overdue(t: SyntheticTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return batch.cascade_delete(t["invoices"], t["invoice_items"], t["invoices"].filter("status = 'overdue'"))


def resolve_products(t: SyntheticTables, mode: str) -> DataFrame:
    rows = t["part"].selectExpr(
        "p_partkey AS id",
        "concat('U', p_partkey % 7) AS uomCode",
        "concat('W', p_partkey % 25) AS warehouseCode",
        "concat('L', p_partkey % 5) AS locationCode",
    )
    return batch.resolve_products(rows, t["uoms"], t["warehouses"], t["locations"], mode)


def rent_quote(t: SyntheticTables) -> DataFrame:
    requests = t["locations"].selectExpr("warehouseId", "area", "CASE WHEN id % 4 > 0 THEN 1 + id % 12 END AS months")
    return dashboard.rent_quote(t, requests)


def stocktake_variance(t: SyntheticTables) -> DataFrame:
    sheet = t["part"].filter("p_size > 25").selectExpr("p_partkey AS productId", "p_size AS countedQty")
    return dashboard.stocktake_variance(t, sheet)


def csv_export(t: SyntheticTables) -> DataFrame:
    listed = t["part"].selectExpr("concat('SKU-', p_partkey) AS code", "concat(p_name, ' 24\"') AS name", "p_brand AS brand")
    return files.csv_lines(listed)


def json_rows(t: SyntheticTables) -> DataFrame:
    return files.json_rows(t["customers"].select("id", "code", "name", "status"))


def csv_sink(t: SyntheticTables) -> DataFrame:
    listed = t["part"].selectExpr("concat('SKU-', p_partkey) AS code", "concat(p_name, ' 24\"') AS name", "p_brand AS brand")
    path = new_path(listed.sparkSession, "csv")
    files.write_csv(listed, path)
    return listed.sparkSession.read.schema(listed.schema).csv(path, header=True, escape='"')


def json_sink(t: SyntheticTables) -> DataFrame:
    listed = t["customers"].select("id", "code", "name", "status")
    path = new_path(listed.sparkSession, "json")
    files.write_json(listed, path)
    return listed.sparkSession.read.schema(listed.schema).json(path)


def ledger_by_month(t: SyntheticTables) -> DataFrame:
    """The summary of a year, from a ledger that was written by month."""
    ledger_rows = t["transactions"]
    path = new_path(ledger_rows.sparkSession, "ledger")
    files.append_ledger(ledger_rows, path)
    return ledger.ledger_summary({"transactions": ledger_rows.sparkSession.read.parquet(path)}, **YEAR)


def _history(t: SyntheticTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(an earlier version of the ledger, lines that came, lines that went); late, corrected and deleted lines, all before 1993."""
    now, quantity = t["transactions"], F.col("quantity")
    early = F.col("transactionDate") < "1993-01-01"
    corrected = now.filter(early & (quantity == 11))
    as_it_was = corrected.withColumns({"quantity": F.lit(12.5), "type": F.lit("inbound")})
    deleted = now.filter(early & (quantity == 13)).withColumns({"id": F.concat("id", F.lit("-x")), "productId": F.col("productId") + 1})
    kept = now.filter(~(early & quantity.isin(7.0, 11.0)))
    before = kept.unionByName(as_it_was).unionByName(deleted)
    return before, now.filter(early & (quantity == 7)).unionByName(corrected), as_it_was.unionByName(deleted)


def on_hand_changes(t: SyntheticTables) -> DataFrame:
    """Stored partial sums of the earlier ledger, and the changes since."""
    before, came, went = _history(t)
    path = new_path(before.sparkSession, "stock")
    snapshot.build(before, path)
    return snapshot.totals(snapshot.with_changes(snapshot.read(before.sparkSession, path), came, went), ("onHand",))


def refreshed_snapshot(t: SyntheticTables) -> DataFrame:
    """Stored partial sums after the months that changed were replaced in the stored ledger and summed anew."""
    before, came, went = _history(t)
    spark = before.sparkSession
    stored, path = new_path(spark, "ledger"), new_path(spark, "stock")
    files.append_ledger(before, stored)
    snapshot.build(spark.read.parquet(stored), path)
    months = snapshot.changed_months(came, went)
    files.replace_months(t["transactions"], stored, months)
    snapshot.refresh(spark.read.parquet(stored), path, months)
    return snapshot.read(spark, path)


def _on_snapshot(operator: Callable[..., DataFrame], **params: object) -> Callable[[SyntheticTables], DataFrame]:
    return lambda t: operator(ChainMap({"stock_snapshot": refreshed_snapshot(t)}, t), **params)


def repeated_append(t: SyntheticTables) -> DataFrame:
    """Two batches, the first one appended twice, and once more with other rows in between."""
    rows = t["transactions"]
    path = new_path(rows.sparkSession, "ledger")
    first, second = rows.filter("quantity <= 20"), rows.filter("quantity > 20")
    for name, lines in (("one", second), ("two/of 2", second), ("one", first), ("one", first)):
        files.append_ledger(lines, path, batch=name)
    return ledger.ledger_summary({"transactions": rows.sparkSession.read.parquet(path)})


def broken_documents(t: SyntheticTables) -> DataFrame:
    """Slips as JSON lines: every tenth is cut off, every tenth has a text for a number, every tenth is no JSON at all."""
    whole = """concat('{"id":"', o_orderkey, '","type":"IN","warehouseId":"', o_custkey, '","lines":[{"productId":"p","qty":', {0}, '}]}')"""
    line = f"""CASE o_orderkey % 10 WHEN 0 THEN left({whole.replace("{0}", "1")}, 30) WHEN 1 THEN {whole.replace("{0}", "'\"many\"'")}
               WHEN 2 THEN concat('no document ', o_orderkey) ELSE {whole.replace("{0}", "o_orderkey % 7")} END AS value"""
    lines = t["orders"].selectExpr(line)
    path = new_path(lines.sparkSession, "slips")
    lines.write.text(path)
    sound, rejected = files.sound_documents(lines.sparkSession, path)
    told = sound.select("id", "warehouseId", F.col("lines")[0]["qty"].alias("qty"), F.lit("").alias("line"))
    return told.unionByName(rejected.select("line"), allowMissingColumns=True)


def _by_id(t: SyntheticTables, name: str, operator: Callable[..., DataFrame]) -> DataFrame:
    """The row of the largest id, looked up in a table that was written for it."""
    rows = t[name]
    path = new_path(rows.sparkSession, name)
    files.write_by_id(rows, path)
    largest = rows.agg(F.max("id")).first()[0]
    return operator(ChainMap({name: rows.sparkSession.read.schema(rows.schema).parquet(path)}, t), id=largest)


def stored_tables(t: SyntheticTables) -> DataFrame:
    """The product list, from tables that were written and read by their declared schemas."""
    names = ["products", "warehouses", "locations", "uoms"]
    spark = t["products"].sparkSession
    folder = new_path(spark, "tables")
    for name in names:
        t[name].write.parquet(f"{folder}/{name}")
    listed = catalog.product_list(files.read_tables(spark, folder, names))
    return listed.select(*t["products"].columns, "uomName", "warehouseName", "locationName")


def _indexed(t: SyntheticTables, name: str, columns: tuple[str, ...], operator: Callable[..., DataFrame], keyword: str) -> DataFrame:
    """A search over a table that was written by id, with the postings of its text."""
    rows = t[name]
    spark = rows.sparkSession
    path, postings = new_path(spark, name), new_path(spark, "postings")
    files.write_by_id(rows, path)
    search_index.build(rows, columns, postings)
    stored = spark.read.schema(rows.schema).parquet(path)
    found = search_index.candidates(stored, search_index.read(spark, postings), keyword)
    return operator(ChainMap({name: found}, t), keyword=keyword)


def distinct_products(t: SyntheticTables, **by: Column) -> DataFrame:
    """Products that moved, from stored bit maps by day; coarser groups are merged from them."""
    path = new_path(t["part"].sparkSession, "bit-maps")
    distinct.bit_maps(t["transactions"], "productId", {"date": F.date_format("transactionDate", "yyyy-MM-dd")}).write.parquet(path)
    days = t["part"].sparkSession.read.schema("date string, block bigint, bits binary").parquet(path)
    return distinct.counts(distinct.merged(days, by) if by else days, list(by) or ["date"], "uniqueProducts")


def _stored(df: DataFrame, key: str = "id") -> buckets.Stored:
    return buckets.write(df, new_path(df.sparkSession, "stored"), key, 16)


def stored_upsert(t: SyntheticTables, part: int) -> DataFrame:
    """The changes of products, made in the table stored in buckets."""
    target, changes = _product_changes(t)
    stored = _stored(target)
    rejected = versions.upsert(stored, changes, "products")
    return (stored.rows(), rejected.select("id", "name", "sku", "unitPrice", "reject_reason"))[part]


def stored_replace(t: SyntheticTables, part: int) -> DataFrame:
    heads, items = _stored(_taxed(t)), _stored(t["invoice_items"], "invoiceId")
    versions.replace_children(heads, items, t["invoice_items"].filter("lineNo <= 2").drop("total"))
    return (heads, items)[part].rows()


def stored_cascade(t: SyntheticTables, part: int) -> DataFrame:
    heads, items = _stored(t["invoices"]), _stored(t["invoice_items"], "invoiceId")
    versions.cascade_delete(heads, items, t["invoices"].filter("status = 'overdue'"))
    return (heads, items)[part].rows()


def stored_guarded_delete(t: SyntheticTables) -> DataFrame:
    stored = _stored(t["products"])
    rejected = versions.guarded_delete(t, "products", stored, t["products"])
    held = rejected.select("id", F.col("transactionCount").cast("string").alias("held_by"))
    return stored.rows().select("id").join(held, "id", "left")


def stored_ledger_changes(t: SyntheticTables) -> DataFrame:
    """Lines corrected and moved to another month, and others deleted, in a ledger stored by month."""
    rows = t["transactions"]
    spark = rows.sparkSession
    path = new_path(spark, "ledger")
    files.append_ledger(rows, path)
    early = rows.filter("transactionDate < '1993-01-01'")
    corrected = early.filter("quantity = 11").select("id").distinct().selectExpr(
        "id", "1.5D AS quantity", "2.5D AS unitPrice", "timestamp_ntz '1993-06-15 10:00:00' AS transactionDate", "timestamp_ntz '2024-01-01' AS updatedAt"
    )
    versions.upsert_ledger(spark.read.parquet(path), path, corrected)
    versions.delete_from_ledger(spark.read.parquet(path), path, early.filter("quantity = 13").select("id"))
    return spark.read.parquet(path).select("id", "type", "productId", "warehouseId", "quantity", "unitPrice", "transactionDate")


def ledger_list_skewed(t: SyntheticTables) -> DataFrame:
    """All ledger rows, nine tenths of them of one product."""
    hot = t["transactions"].withColumn("productId", F.when(F.col("quantity") < 45, 7).otherwise(F.col("productId")).cast("bigint"))
    return ledger.ledger_list(ChainMap({"transactions": hot}, t), limit=None, ordered=False, skewed=True)


OPERATORS: dict[str, Callable[[SyntheticTables], DataFrame]] = {
    # Reports
    "overview": reports.overview,
    "overview_range": lambda t: reports.overview(t, **YEAR),
    "inventory_by_warehouse": reports.inventory_by_warehouse,
    "inventory_by_product": reports.inventory_by_product,
    "inventory_by_product_filtered": lambda t: reports.inventory_by_product(t, category="ECONOMY", stock_status_is="low"),
    "transactions_timeline": reports.transactions_timeline,
    "transactions_timeline_range": lambda t: reports.transactions_timeline(t, **YEAR, type="outbound"),
    "transfer_report": reports.transfer_report,
    "transfer_report_range": lambda t: reports.transfer_report(t, **YEAR, from_warehouse_id=3),
    "adjustment_report": reports.adjustment_report,
    "adjustment_report_reason": lambda t: reports.adjustment_report(t, reason="r"),
    "stocktake_report": reports.stocktake_report,
    "revenue_timeline": reports.revenue_timeline,
    "revenue_timeline_week": lambda t: reports.revenue_timeline(t, group_by="week"),
    "revenue_timeline_month": lambda t: reports.revenue_timeline(t, group_by="month", **YEAR),
    "top_products": _top_products,
    "top_products_by_quantity": lambda t: _top_products(t, sort_by="quantity", limit=25),
    "top_products_by_transactions": lambda t: _top_products(t, sort_by="transactions", limit=25),
    "warehouse_performance": reports.warehouse_performance,
    "warehouse_performance_exact": lambda t: reports.warehouse_performance(t, mode="exact"),
    "warehouse_performance_range": lambda t: reports.warehouse_performance(t, **WEEK),
    "trends": reports.trends,
    "trends_quantity": lambda t: reports.trends(t, period=365, metric="quantity"),
    "trends_transactions": lambda t: reports.trends(t, period=90, metric="transactions"),
    "low_stock_alert": reports.low_stock_alert,
    "low_stock_alert_all": lambda t: reports.low_stock_alert(t, limit=None),
    "storage_cost": reports.storage_cost,
    "storage_cost_range": lambda t: reports.storage_cost(t, **WEEK),
    "warehouse_efficiency": reports.warehouse_efficiency,
    "warehouse_efficiency_exact": lambda t: reports.warehouse_efficiency(t, mode="exact"),
    # Ledger
    "ledger_list": ledger.ledger_list,
    "ledger_list_all": lambda t: ledger.ledger_list(t, limit=None, ordered=False),
    "ledger_summary": ledger.ledger_summary,
    "ledger_daily": ledger.ledger_daily,
    "on_hand": ledger.on_hand,
    # Products, warehouses, locations
    "product_list": catalog.product_list,
    "product_search": lambda t: catalog.product_search(t, "RED"),
    "product_stock": catalog.product_stock,
    "warehouse_stock": catalog.warehouse_stock,
    "warehouse_products": catalog.warehouse_products,
    "warehouse_list": catalog.warehouse_list,
    "warehouse_list_exact": lambda t: catalog.warehouse_list(t, mode="exact"),
    "warehouse_stats": catalog.warehouse_stats,
    "warehouse_locations": catalog.warehouse_locations,
    "warehouse_usage_report": catalog.warehouse_usage_report,
    "location_list": catalog.location_list,
    "location_list_by_type": lambda t: catalog.location_list(t, type="storage", with_value=False),
    "location_products": catalog.location_products,
    "warehouse_map": catalog.warehouse_map,
    "available_locations": lambda t: catalog.available_locations(t, min_area=30),
    "location_stats_by_warehouse": catalog.location_stats_by_warehouse,
    "location_stats_by_warehouse_exact": lambda t: catalog.location_stats_by_warehouse(t, mode="exact"),
    # Customers and invoices
    "customer_list": billing.customer_list,
    "customer_search": lambda t: billing.customer_list(t, keyword="build_NG"),
    "customer_transactions": lambda t: billing.customer_transactions(
        ChainMap({"transactions": t["customer_ledger"]}, t)
    ),
    "invoice_list": billing.invoice_list,
    "invoice_search": lambda t: billing.invoice_list(t, keyword="inv-1"),
    "invoice_document": invoice_document,
    "invoice_summary": billing.invoice_summary,
    "invoice_summary_range": lambda t: billing.invoice_summary(t, **YEAR),
    "invoice_monthly": billing.invoice_monthly,
    "invoice_monthly_year": lambda t: billing.invoice_monthly(t, 1996),
    "invoice_totals": lambda t: billing.invoice_totals(t["invoice_items"], 8.0),
    # Maintenance
    "maintenance_plans": maintenance.maintenance_plans,
    "maintenance_progress": maintenance.maintenance_progress,
    "incidents": maintenance.incidents,
    "staff_workload": maintenance.staff_workload,
    "staff_workload_exact": lambda t: maintenance.staff_workload(t, specialty="TH", mode="exact"),
    "maintenance_stats": maintenance.maintenance_stats,
    "maintenance_stats_range": lambda t: maintenance.maintenance_stats(t, "2024-01-05", "2024-01-11"),
    # Dashboard
    "dashboard_kpis": dashboard.dashboard_kpis,
    "in_out_last_days": dashboard.in_out_last_days,
    "top_on_hand": dashboard.top_on_hand,
    "top_moved_in": dashboard.top_moved,
    "top_moved_out": lambda t: dashboard.top_moved(t, type="OUT"),
    "signed_value_trend": dashboard.signed_value_trend,
    "area_utilization": dashboard.area_utilization,
    "free_area_by_warehouse": dashboard.free_area_by_warehouse,
    "low_stock_share": dashboard.low_stock_share,
    "revenue_by_warehouse": dashboard.revenue_by_warehouse,
    "revenue_by_group": lambda t: dashboard.revenue_by_group(t, "category"),
    "movement_report": dashboard.movement_report,
    "movement_report_range": lambda t: dashboard.movement_report(t, warehouse_id=7, **YEAR),
    "rent_quote": rent_quote,
    "reprice": lambda t: dashboard.reprice(t, 7.5, "cold"),
    "stocktake_variance": stocktake_variance,
    "product_card": lambda t: dashboard.product_card(t, "2024-01-01T00:00:00.000Z"),
    "location_status_counts": dashboard.location_status_counts,
    "plan_status_counts": dashboard.plan_status_counts,
    # Search
    "entity_search": lambda t: search.entity_search(t, "1"),
    "entity_search_customers": lambda t: search.entity_search(t, "Machine", "customers"),
    "advanced_search": lambda t: search.advanced_search(t, start="1996-06-01", end="2024-08-31"),
    "advanced_search_customer": lambda t: search.advanced_search(t, customer="C-7", status="pending"),
    "filtered_products": lambda t: search.filtered_products(t, "Blue"),
    "filtered_customers": lambda t: search.filtered_customers(t, "C12", status="active"),
    "filtered_invoices": lambda t: search.filtered_invoices(t, "urgent", type="Nhập", status="paid"),
    # Bulk maintenance
    "validate_products": validate_products,
    "validate_transactions": validate_transactions,
    "reject_duplicates": reject_duplicates,
    "post_outbound": post_outbound,
    "post_outbound_rejected": post_outbound_rejected,
    "post_outbound_blanks": post_outbound_blanks,
    "expand_transfers": expand_transfers,
    "expand_adjustments": expand_adjustments,
    "upsert_latest": lambda t: _upserted(t, False)[0],
    "upsert_latest_rejected": upsert_latest_rejected,
    "upsert_latest_insert": lambda t: _upserted(t, True)[0],
    "update_invoices": lambda t: _updated_invoices(t)[0],
    "update_invoices_items": lambda t: _updated_invoices(t)[1],
    "update_invoices_rejected": lambda t: _updated_invoices(t)[2].select("id", "invoiceNumber", "reject_reason"),
    "upsert_area_usage": upsert_area_usage,
    "post_invoices": lambda t: _posted_invoices(t)[0],
    "post_invoices_items": lambda t: _posted_invoices(t)[1],
    "plain_delete": lambda t: plain_delete(t)[0],
    "plain_delete_rejected": lambda t: plain_delete(t)[1],
    "replace_children_invoices": lambda t: _replaced(t)[0],
    "replace_children_items": lambda t: _replaced(t)[1],
    "guarded_delete_products": lambda t: _deleted(t, "products"),
    "guarded_delete_warehouses": lambda t: _deleted(t, "warehouses"),
    "guarded_delete_locations": lambda t: _deleted(t, "locations"),
    "guarded_delete_customers": lambda t: _deleted(t, "customers"),
    "cascade_delete_invoices": lambda t: _overdue(t)[0],
    "cascade_delete_items": lambda t: _overdue(t)[1],
    "latest_plan_status": lambda t: batch.latest_plan_status(t["maintenance_plans"], t["maintenance_progress"]),
    "documents_to_ledger": lambda t: batch.documents_to_ledger(t["nested_documents"], t["products"]),
    "resolve_products": lambda t: resolve_products(t, "reference"),
    "resolve_products_exact": lambda t: resolve_products(t, "exact"),
    "csv_export": csv_export,
    "json_rows": json_rows,
    "csv_sink": csv_sink,
    "json_sink": json_sink,
    "ledger_by_month": ledger_by_month,
    # Stored state, repeated writes, look-ups
    "on_hand_changes": on_hand_changes,
    "on_hand_snapshot": _on_snapshot(ledger.on_hand),
    "inventory_by_product_snapshot": _on_snapshot(reports.inventory_by_product),
    "inventory_by_warehouse_snapshot": _on_snapshot(reports.inventory_by_warehouse),
    "low_stock_alert_snapshot": _on_snapshot(reports.low_stock_alert, limit=None),
    "repeated_append": repeated_append,
    "broken_documents": broken_documents,
    "ledger_by_id": lambda t: _by_id(t, "transactions", ledger.ledger_list),
    "invoice_by_id": lambda t: invoice_document(t, lambda tables: _by_id(t, "invoices", billing.invoice_document)),
    "product_by_id": lambda t: _by_id(t, "products", catalog.product_list),
    "stored_tables": stored_tables,
    "product_search_indexed": lambda t: _indexed(t, "products", catalog.PRODUCT_TEXT, catalog.product_search, "RED"),
    "customer_search_indexed": lambda t: _indexed(t, "customers", billing.CUSTOMER_TEXT, billing.customer_list, "build_NG"),
    "stored_upsert": lambda t: stored_upsert(t, 0),
    "stored_upsert_rejected": lambda t: stored_upsert(t, 1),
    "stored_replace_invoices": lambda t: stored_replace(t, 0),
    "stored_replace_items": lambda t: stored_replace(t, 1),
    "stored_cascade_invoices": lambda t: stored_cascade(t, 0),
    "stored_cascade_items": lambda t: stored_cascade(t, 1),
    "stored_guarded_delete": stored_guarded_delete,
    "stored_ledger_changes": stored_ledger_changes,
    "ledger_list_skewed": ledger_list_skewed,
    "distinct_products_daily": distinct_products,
    "distinct_products_monthly": lambda t: distinct_products(t, month=F.substring("date", 1, 7)),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    operator = OPERATORS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(operator(SyntheticTables(spark, folder)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in OPERATORS}
