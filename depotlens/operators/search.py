"""Search over unlike entities in one row shape: kind, code, name, info, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import any_of, contains_folded, or_default, where_equal
from depotlens.plans.parts import heads
from depotlens.plans.stock import Tables

# The labels shown for kinds and statuses.
PRODUCT_KIND, CUSTOMER_KIND, CONTRACT_KIND, INVOICE_KIND = "Sản phẩm", "Khách hàng", "Hợp đồng", "Hóa đơn"
IN_SLIP_KIND, OUT_SLIP_KIND = "Phiếu Nhập", "Phiếu Xuất"
ACTIVE, INACTIVE, DONE = "Hoạt động", "Không hoạt động", "Hoàn thành"
CONTRACT_WAITING, PAID, OVERDUE, INVOICE_WAITING = "Chờ xử lý", "Đã thanh toán", "Quá hạn", "Chờ thanh toán"


def _text(*parts: Column | str) -> Column:
    """Concatenation in which a missing part is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _grouped(amount: str) -> Column:
    """1234567.5 -> 1,234,567.5 (up to three decimals)."""
    return F.call_function("format_number", F.col(amount), F.lit("#,##0.###"))


def _row(df: DataFrame, kind: Column, code: str, name: Column, info: Column, status: Column) -> DataFrame:
    return df.select(
        kind.alias("kind"), F.col(code).alias("code"), name.alias("name"), info.alias("info"), status.alias("status")
    )


def _products(df: DataFrame) -> DataFrame:
    info = _text("Đơn vị: ", or_default(F.col("uom"), "N/A"))
    return _row(df, F.lit(PRODUCT_KIND), "sku", F.col("name"), info, F.lit(ACTIVE))


def _documents(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "IN", IN_SLIP_KIND).otherwise(OUT_SLIP_KIND)
    name = _text(F.col("lineCount"), " dòng")
    return _row(df, kind, "code", name, _text("Ngày: ", F.date_format("createdAt", "yyyy-MM-dd")), F.lit(DONE))


def _customers(df: DataFrame) -> DataFrame:
    info = _text("Liên hệ: ", F.col("contactPerson"), " - ", F.col("phone"))
    status = F.when(F.col("status") == "active", ACTIVE).otherwise(INACTIVE)
    return _row(df, F.lit(CUSTOMER_KIND), "code", F.col("name"), info, status)


def _contracts(df: DataFrame) -> DataFrame:
    info = _text("KH: ", F.col("customerName"), " - Giá trị: ", _grouped("value"), "đ")
    status = (
        F.when(F.col("status") == "active", ACTIVE)
        .when(F.col("status") == "completed", DONE)
        .otherwise(CONTRACT_WAITING)
    )
    return _row(df, F.lit(CONTRACT_KIND), "code", F.col("description"), info, status)


def _invoices(df: DataFrame) -> DataFrame:
    info = _text("KH: ", F.col("customerName"), " - Tổng: ", _grouped("totalWithTax"), "đ")
    status = (
        F.when(F.col("status") == "paid", PAID).when(F.col("status") == "overdue", OVERDUE).otherwise(INVOICE_WAITING)
    )
    return _row(df, F.lit(INVOICE_KIND), "code", F.col("description"), info, status)


def _with_line_count(tables: Tables, documents: DataFrame) -> DataFrame:
    """Slips with their number of lines, counted from whichever form the lines come in."""
    if "itemCount" in documents.columns:
        return heads(documents).withColumn("lineCount", F.col("itemCount"))
    if "lines" in documents.columns:
        return documents.withColumn("lineCount", F.coalesce(F.size("lines"), F.lit(0)))
    counts = (
        tables["document_lines"].groupBy(F.col("documentId").alias("_slip")).agg(F.count("*").alias("lineCount"))
    )
    joined = documents.join(counts, F.col("id") == F.col("_slip"), "left").drop("_slip")
    return joined.fillna(0, subset=["lineCount"])


SEARCHED = {
    "products": (("sku", "name"), _products),
    "documents": (("code",), _documents),
    "customers": (("code", "name", "contactPerson"), _customers),
    "contracts": (("code", "customerName", "description"), _contracts),
    "invoice_documents": (("code", "customerName", "description"), _invoices),
}


SEARCH_NAMES = {"transactions": "documents", "invoices": "invoice_documents"}


def entity_search(tables: Tables, term: str = "", type: str = "all") -> DataFrame:
    """Products, stock slips, customers, contracts and invoices whose text contains the term.

    ``type`` is ``all``, one of the keys of ``SEARCHED``, or ``transactions`` or ``invoices``
    for the slips and invoices; any other is an error.
    """
    type = SEARCH_NAMES.get(type, type)
    if type != "all" and type not in SEARCHED:
        raise ValueError(f"unknown type {type!r}")
    found = []
    for entity, (columns, shape) in SEARCHED.items():
        matching = tables[entity].filter(any_of([contains_folded(c, term) for c in columns]))
        if type not in ("all", entity):
            matching = matching.filter(F.lit(False))
        if entity == "documents":
            matching = _with_line_count(tables, matching)
        if entity == "products" and "uom" not in matching.columns:
            matching = matching.withColumn("uom", F.lit(None).cast("string"))
        found.append(shape(matching))
    return reduce(DataFrame.unionByName, found)


def advanced_search(
    tables: Tables,
    customer: str | None = None,
    status: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Contracts and invoices of a customer code and status that begin and end in a range."""
    found = []
    for entity, begins, ends, shape in (
        ("contracts", "startDate", "endDate", _contracts),
        ("invoice_documents", "issueDate", "dueDate", _invoices),
    ):
        rows = where_equal(tables[entity], customerCode=customer, status=status)
        if start:
            rows = rows.filter(F.col(begins) >= F.lit(start))
        if end:
            rows = rows.filter(F.col(ends) <= F.lit(end))
        found.append(shape(rows))
    return reduce(DataFrame.unionByName, found)


def _filtered(df: DataFrame, columns: tuple[str, ...], term: str, **equal: str | None) -> DataFrame:
    if term:
        df = df.filter(any_of([contains_folded(c, term) for c in columns]))
    return where_equal(df, **equal)


def filtered_products(tables: Tables, term: str = "") -> DataFrame:
    return _filtered(tables["products"], ("sku", "name"), term)


def filtered_customers(tables: Tables, term: str = "", status: str | None = None) -> DataFrame:
    customers = tables["customers"]
    if term:
        folded = [contains_folded(c, term) for c in ("code", "name", "contactPerson", "email")]
        # The phone number is compared as it is written, only the term is folded.
        customers = customers.filter(any_of([*folded, F.col("phone").contains(F.lower(F.lit(term)))]))
    return where_equal(customers, status=status)


def filtered_invoices(
    tables: Tables, term: str = "", type: str | None = None, status: str | None = None
) -> DataFrame:
    columns = ("code", "customerName", "description")
    return _filtered(tables["invoice_documents"], columns, term, type=type, status=status)
