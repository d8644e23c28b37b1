"""Customers and invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import any_of, like_ascii, where_equal
from depotlens.functions.dates import in_days
from depotlens.functions.numbers import exact_avg, exact_sum, zero_if_null
from depotlens.plans.lookups import lookup, only_keys_of, sorted_list
from depotlens.plans.parts import nest_children
from depotlens.plans.stock import Tables

CUSTOMER_TEXT = ("name", "code", "contactPerson", "phone")


def customer_list(tables: Tables, id: int | None = None, keyword: str | None = None) -> DataFrame:
    """Customers with number and sum of their invoices."""
    customers = where_equal(tables["customers"], id=id)
    if keyword:
        customers = customers.filter(any_of([like_ascii(c, keyword) for c in CUSTOMER_TEXT]))
    billed = (
        tables["invoices"]
        .filter(F.col("customerId").isNotNull())
        .groupBy(F.col("customerId").alias("_customer"))
        .agg(F.count("*").alias("totalInvoices"), zero_if_null(exact_sum(F.col("total"))).alias("totalRevenue"))
    )
    joined = customers.join(billed, F.col("id") == F.col("_customer"), "left").drop("_customer")
    return joined.fillna(0, subset=["totalInvoices", "totalRevenue"]).orderBy("name", "id")


def customer_transactions(tables: Tables, id: int | None = None, ordered: bool = True) -> DataFrame:
    """Ledger rows that carry a customer's *name*, newest first.

    Customers who share a name each get all of these rows.
    """
    customers = where_equal(tables["customers"], id=id).select(
        F.col("id").alias("customerId"), F.col("name").alias("_name")
    )
    found = tables["transactions"].join(customers, F.col("customer") == F.col("_name")).drop("_name")
    found = lookup(found, tables["products"], "productId", productName="name", productSku="sku")
    found = lookup(found, tables["warehouses"], "warehouseId", warehouseName="name")
    return sorted_list(found, F.desc("transactionDate"), "id", "customerId", ordered=ordered)


INVOICE_TEXT = ("invoiceNumber", "customerName", "customerCode")


def invoice_list(
    tables: Tables, customer_id: int | None = None, keyword: str | None = None, ordered: bool = True
) -> DataFrame:
    """Invoices with customer, number of items and item sum (NULL without items)."""
    invoices = where_equal(tables["invoices"], customerId=customer_id)
    named = lookup(invoices, tables["customers"], "customerId", customerName="name", customerCode="code")
    if keyword:
        named = named.filter(any_of([like_ascii(c, keyword) for c in INVOICE_TEXT]))
    lines = tables["invoice_items"]
    if customer_id is not None or keyword:
        wanted = named.select(F.col("id").alias("invoiceId"))
        lines = only_keys_of(lines, wanted, ["invoiceId"], invoices.select("id"))
    items = lines.groupBy(F.col("invoiceId").alias("_invoice")).agg(
        F.count("*").alias("itemCount"), exact_sum(F.col("total")).alias("calculatedTotal")
    )
    joined = named.join(items, F.col("id") == F.col("_invoice"), "left").drop("_invoice")
    return sorted_list(joined.fillna(0, subset=["itemCount"]), F.desc("invoiceDate"), "id", ordered=ordered)


ITEMS_PER_DOCUMENT = 10_000


def invoice_document(tables: Tables, id: int | None = None, part_limit: int = ITEMS_PER_DOCUMENT) -> DataFrame:
    """Invoice header with its items nested, each with product name and SKU.

    Always with ``part``, ``partCount`` and ``itemCount`` (of the whole invoice). ``part_limit`` is the page size: part k
    holds the items from k * ``part_limit`` on. Invoices without items are one part with an empty array.
    """
    items = where_equal(tables["invoice_items"], invoiceId=id)
    columns = [c for c in items.columns if c != "invoiceId"]
    named = lookup(items, tables["products"], "productId", productName="name", productSku="sku")
    spread = [c for c in ("id", "productId", "quantity", "total") if c in columns]
    header = lookup(
        where_equal(tables["invoices"], id=id),
        tables["customers"],
        "customerId",
        customerName="name",
        customerCode="code",
    )
    item = F.struct(*columns, "productName", "productSku")
    return nest_children(header, named, "invoiceId", item, "items", spread, part_limit)


def invoice_summary(
    tables: Tables, start: str | None = None, end: str | None = None, customer_id: int | None = None
) -> DataFrame:
    """One row of invoice counts by status, revenue, average and first and last date."""
    invoices = in_days(where_equal(tables["invoices"], customerId=customer_id), "invoiceDate", start, end)
    return invoices.agg(
        F.count("*").alias("totalInvoices"),
        F.count_if(F.col("status") == "paid").alias("paidInvoices"),
        F.count_if(F.col("status") == "pending").alias("pendingInvoices"),
        F.count_if(F.col("status") == "overdue").alias("overdueInvoices"),
        exact_sum(F.col("total")).alias("totalRevenue"),
        exact_avg(F.col("total")).alias("averageInvoiceValue"),
        F.min("invoiceDate").alias("firstInvoiceDate"),
        F.max("invoiceDate").alias("lastInvoiceDate"),
    )


def invoice_monthly(tables: Tables, year: int | None = None) -> DataFrame:
    """Invoices per month of a year; without a year, of the newest year that has invoices."""
    invoices = tables["invoices"]
    if year is not None:
        invoices = in_days(invoices, "invoiceDate", f"{int(year):04d}-01-01", f"{int(year):04d}-12-31")
    else:
        newest = invoices.select(F.trunc(F.max("invoiceDate"), "year")).scalar()
        invoices = invoices.filter(F.col("invoiceDate") >= newest)
    return (
        invoices.groupBy(F.date_format("invoiceDate", "MM").alias("month"))
        .agg(
            F.count("*").alias("invoiceCount"),
            exact_sum(F.col("total")).alias("totalRevenue"),
            exact_avg(F.col("total")).alias("averageRevenue"),
        )
        .orderBy("month")
    )


BROWSER_TAX_RATE = 10.0


def invoice_totals(items: DataFrame, tax_rate: float = BROWSER_TAX_RATE) -> DataFrame:
    """Subtotal, tax and total per invoice from quantity and unit price of its items."""
    subtotals = items.groupBy("invoiceId").agg(
        zero_if_null(exact_sum(F.col("quantity") * F.col("unitPrice"))).alias("subtotal")
    )
    tax = F.col("subtotal") * F.lit(float(tax_rate)) / F.lit(100.0)
    return subtotals.withColumn("taxAmount", tax).withColumn("total", F.col("subtotal") + F.col("taxAmount"))
