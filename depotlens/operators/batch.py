"""Bulk checks and new table versions. Nothing is updated in place: write the result to a
new directory and switch to it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.columns import is_blank
from depotlens.functions.numbers import zero_if_null
from depotlens.operators.billing import invoice_totals
from depotlens.plans.lookups import lookup, only_keys_of


class Rules(NamedTuple):
    required: tuple[str, ...] = ()
    allowed: Mapping[str, tuple[str, ...]] = {}
    not_negative: tuple[str, ...] = ()
    defaults: Mapping[str, Any] = {}
    fixed: Mapping[str, Any] = {}


# What the original application asks of a new record. ``defaults`` replace
# blank values, ``fixed`` values are set whatever the record says.
RULES = {
    "products": Rules(("name", "sku")),
    "warehouses": Rules(("name", "code"), defaults={"country": "Vietnam", "type": "general", "rentalPrice": 0.0}),
    "locations": Rules(("warehouseId", "code", "name"), defaults={"type": "storage"}, fixed={"status": "available"}),
    "customers": Rules(("name", "code"), defaults={"country": "Vietnam", "creditLimit": 0.0}),
    "transactions": Rules(
        ("type", "productId", "warehouseId", "quantity"),
        {"type": ("inbound", "outbound", "transfer", "adjustment", "stocktake")},
    ),
    "transfers": Rules(("productId", "fromWarehouseId", "toWarehouseId", "quantity")),
    "adjustments": Rules(("productId", "warehouseId", "quantity", "reason")),
    "invoices": Rules(("invoiceNumber", "customerId", "invoiceDate", "items"), defaults={"taxRate": 0.0}),
    "maintenance_plans": Rules(
        ("warehouseId", "title", "plannedDate"),
        defaults={"type": "preventive", "priority": "medium", "estimatedDuration": 1, "estimatedCost": 0.0},
        fixed={"status": "planned"},
    ),
    "maintenance_progress": Rules(("status",), defaults={"progressPercent": 0, "actualCost": 0.0}),
    "incidents": Rules(
        ("warehouseId", "title", "description"),
        defaults={"type": "equipment", "severity": "medium"},
        fixed={"status": "reported"},
    ),
    "maintenance_staff": Rules(("name", "code"), fixed={"status": "active"}),
    "location_status": Rules(("status",), {"status": ("available", "occupied", "full", "maintenance")}),
    # 0 is a valid area, so it is not in ``required``.
    "area_usage": Rules(not_negative=("usedArea",)),
}


def validate_batch(batch: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(records with defaults filled in, rejected records with the first ``reject_reason``)."""
    rules = RULES[entity]
    accepted, rejected = _judged(batch, rules)
    return _completed(accepted, rules.defaults, rules.fixed), rejected


def _judged(batch: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    reasons = [F.when(is_blank(batch, c), f"{c} is missing") for c in rules.required]
    reasons += [F.when(~F.col(c).isin(*values), f"{c} is not allowed") for c, values in rules.allowed.items()]
    reasons += [F.when(F.col(c).isNull() | (F.col(c) < 0), f"{c} is not valid") for c in rules.not_negative]
    judged = batch.withColumn("reject_reason", F.coalesce(*reasons, F.lit(None).cast("string")))
    accepted = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, judged.filter(F.col("reject_reason").isNotNull())


def _completed(df: DataFrame, defaults: Mapping[str, Any], fixed: Mapping[str, Any]) -> DataFrame:
    filled = {}
    for name, value in defaults.items():
        blank = is_blank(df, name)
        filled[name] = F.when(blank, F.lit(value)).otherwise(F.col(name)) if name in df.columns else F.lit(value)
    filled |= {name: F.lit(value) for name, value in fixed.items()}
    return df.withColumns(filled) if filled else df


def reject_duplicates(
    batch: DataFrame, target: DataFrame, key: str, row_id: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(records whose key is new, the others): the lowest ``row_id`` of a key comes first.

    A key is taken from the batch once, whatever its number of copies: the first copy is a
    minimum (combined before the shuffle), and the split is joined by the unique row id, so
    no task meets all copies of a hot key.
    """
    first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row_id).alias(row_id))
    fresh = first.join(target.select(key), key, "left_anti").select(row_id)
    return batch.join(fresh, row_id, "left_semi"), batch.join(fresh, row_id, "left_anti")


# The columns an update overwrites, and its defaults for blank values.
UPDATED = {
    "products": (
        "name sku description manufacturer category uomId warehouseId locationId minStock maxStock unitPrice notes",
        {},
    ),
    "warehouses": (
        "name code address city country phone email manager totalArea type rentalPrice notes",
        {"country": "Vietnam", "type": "general", "rentalPrice": 0.0},
    ),
    "locations": ("code name type area capacity status notes", {"type": "storage", "status": "available"}),
    "customers": (
        "name code contactPerson phone email address city country taxCode creditLimit notes",
        {"country": "Vietnam", "creditLimit": 0.0},
    ),
    "transactions": ("quantity unitPrice supplier customer reference notes transactionDate", {}),
    "maintenance_plans": (
        "title description type priority plannedDate estimatedDuration estimatedCost responsibleStaff status notes",
        {
            "type": "preventive",
            "priority": "medium",
            "estimatedDuration": 1,
            "estimatedCost": 0.0,
            "status": "planned",
        },
    ),
    "incidents": (
        "title description type severity status action resolvedAt resolvedBy notes",
        {"type": "equipment", "severity": "medium", "status": "reported"},
    ),
    "maintenance_staff": ("name code position specialty phone email status notes", {"status": "active"}),
    "location_status": ("status", {}),
    "area_usage": ("usedArea", {}),
}


# What an update must not leave blank.
REQUIRED_ON_UPDATE = {
    "products": Rules(("name", "sku")),
    "warehouses": Rules(("name", "code")),
    "locations": Rules(("code", "name")),
    "customers": Rules(("name", "code")),
    "maintenance_plans": Rules(("title", "plannedDate")),
    "incidents": Rules(("title", "description")),
    "maintenance_staff": Rules(("name", "code")),
    "location_status": RULES["location_status"],
    "area_usage": RULES["area_usage"],
}

UNKNOWN_ID = "id is not known"


def upsert_latest(
    target: DataFrame, changes: DataFrame, entity: str, insert: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(new version of the target, rejected changes): per id the newest sound change (by ``updatedAt``) overwrites.

    An update overwrites every updatable column, also with NULL; a column that neither side
    has is skipped, and one that only the changes lack counts as NULL. Changes that leave a
    required field blank are rejected with their ``reject_reason``, as are those of unknown
    ids, which ``insert=True`` appends. A ledger row without a date gets the time of its update.
    """
    listed, defaults = UPDATED[entity]
    columns = [c for c in listed.split() if c in target.columns]
    changes, rejected = _judged(changes, REQUIRED_ON_UPDATE.get(entity, Rules()))
    if not insert:
        unknown = changes.join(target.select("id"), "id", "left_anti")
        rejected = rejected.unionByName(unknown.withColumn("reject_reason", F.lit(UNKNOWN_ID)))
    complete = changes.withColumns(
        {c: F.lit(None).cast(target.schema[c].dataType) for c in columns if c not in changes.columns}
    )
    complete = _completed(complete, {c: v for c, v in defaults.items() if c in target.columns}, {})
    if "transactionDate" in columns:
        complete = complete.withColumn("transactionDate", F.coalesce("transactionDate", "updatedAt"))
    # Ties in updatedAt are settled by the record itself, so a rerun chooses the same one.
    record = F.struct("updatedAt", *[c for c in complete.columns if c not in ("id", "updatedAt")])
    latest = complete.groupBy("id").agg(F.max(record).alias("new"))
    joined = target.join(latest.select(F.col("id").alias("_id"), "new"), F.col("id") == F.col("_id"), "left")
    overwritten = {
        c: F.when(F.col("_id").isNotNull(), F.col(f"new.{c}").cast(target.schema[c].dataType)).otherwise(F.col(c))
        for c in [*columns, "updatedAt"]
        if c in target.columns
    }
    version = joined.withColumns(overwritten).drop("_id", "new")
    if not insert:
        return version, rejected
    added = latest.join(target.select("id"), "id", "left_anti").select("id", "new.*")
    added = added.select(*[c for c in added.columns if c in target.columns])
    return version.unionByName(added, allowMissingColumns=True), rejected


NUMBER_EXISTS = "invoiceNumber exists"


def post_invoices(batch: DataFrame, invoices: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices with totals, their items, rejected ones) of invoice documents.

    A document has its items nested, as structs with at least productId, quantity and
    unitPrice. The totals are folded inside the document, without a shuffle. With the
    present ``invoices``, documents whose number exists there or in a document of a smaller
    id are rejected.
    """
    accepted, rejected = validate_batch(batch, "invoices")
    if invoices is not None:
        accepted, known = reject_duplicates(accepted, invoices, "invoiceNumber")
        known = known.withColumn("reject_reason", F.lit(NUMBER_EXISTS))
        rejected = rejected.unionByName(known, allowMissingColumns=True)
    return *_totalled(accepted), rejected


def _totalled(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Nine places, as sums of reports have.
    zero = F.lit(0).cast("decimal(37,9)")
    amounts = F.transform("items", lambda i: F.coalesce((i["quantity"] * i["unitPrice"]).cast("decimal(37,9)"), zero))
    subtotal = F.aggregate(amounts, zero, lambda total, amount: (total + amount).cast("decimal(37,9)"))
    tax = F.col("subtotal") * F.col("taxRate") / F.lit(100.0)
    heads = (
        accepted.withColumn("subtotal", subtotal.cast("double"))
        .withColumn("taxAmount", tax)
        .withColumn("total", F.col("subtotal") + F.col("taxAmount"))
        .drop("items")
    )
    items = accepted.select(F.col("id").alias("invoiceId"), F.explode("items").alias("item")).select(
        "invoiceId", "item.*", (F.col("item.quantity") * F.col("item.unitPrice")).alias("total")
    )
    return heads, items


INVOICE_HEADER = "invoiceNumber customerId invoiceDate dueDate subtotal taxRate taxAmount total notes updatedAt"


def update_invoices(
    invoices: DataFrame, items: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, items, rejected documents): header, totals and all items of the documents' invoices change.

    Documents are those of ``post_invoices``, at most one for an invoice. A blank tax rate is 0, and a header column that a
    document lacks becomes NULL. Rejected are documents with a blank required field, of an
    unknown id, and those whose number another invoice, or a document of a smaller id, has.
    """
    sound, blank = validate_batch(documents, "invoices")
    unknown = sound.join(invoices.select("id"), "id", "left_anti").withColumn("reject_reason", F.lit(UNKNOWN_ID))
    known = sound.join(invoices.select("id"), "id", "left_semi")
    held = invoices.select(F.col("id").alias("_holder"), F.col("invoiceNumber").alias("_number"))
    first = known.groupBy(F.col("invoiceNumber").alias("_number")).agg(F.min("id").alias("_holder"))
    same = F.col("invoiceNumber") == F.col("_number")
    free = known
    for holders in (held, first):
        free = free.join(holders, same & (F.col("id") != F.col("_holder")), "left_anti")
    taken = known.join(free.select("id"), "id", "left_anti").withColumn("reject_reason", F.lit(NUMBER_EXISTS))
    rejected = blank.unionByName(unknown, allowMissingColumns=True).unionByName(taken, allowMissingColumns=True)

    heads, new_items = _totalled(free)
    columns = [c for c in INVOICE_HEADER.split() if c in invoices.columns]
    new = heads.select(
        F.col("id").alias("_id"),
        *[(F.col(c) if c in heads.columns else F.lit(None)).cast(invoices.schema[c].dataType).alias(f"_{c}") for c in columns],
    )
    joined = invoices.join(new, F.col("id") == F.col("_id"), "left")
    version = joined.withColumns({c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})
    kept = _without(items, free.select("id"), "invoiceId")
    return version.select(*invoices.columns), kept.unionByName(new_items, allowMissingColumns=True), rejected


def replace_children(
    invoices: DataFrame, items: DataFrame, new_items: DataFrame, tax_rate: float | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices with new totals, items, rejected items): all items of the invoices in ``new_items`` change.

    Item totals are worked out here; items of invoices that do not exist are rejected. The
    tax rate is the one given, else that of the invoice.
    """
    priced = new_items.withColumn("total", F.col("quantity") * F.col("unitPrice"))
    ids = invoices.select(F.col("id").alias("invoiceId"))
    known = priced.join(ids, "invoiceId", "left_semi")
    rejected = new_items.join(ids, "invoiceId", "left_anti").withColumn("reject_reason", F.lit("invoiceId is not known"))
    touched = known.select("invoiceId").distinct()
    kept = items.join(touched, "invoiceId", "left_anti")
    version = kept.unionByName(known, allowMissingColumns=True)

    sums = invoice_totals(known, 0.0).select(F.col("invoiceId").alias("_id"), F.col("subtotal").alias("_subtotal"))
    joined = invoices.join(sums, F.col("id") == F.col("_id"), "left")
    rate = F.lit(float(tax_rate)) if tax_rate is not None else zero_if_null(F.col("taxRate"))
    tax = F.col("_subtotal") * rate / F.lit(100.0)
    changed = {"subtotal": F.col("_subtotal"), "taxRate": rate, "taxAmount": tax, "total": F.col("_subtotal") + tax}
    overwritten = {c: F.when(F.col("_id").isNotNull(), v).otherwise(F.col(c)) for c, v in changed.items()}
    return joined.withColumns(overwritten).drop("_id", "_subtotal"), version, rejected


# The tables that must not refer to a record that is deleted.
GUARDS = {
    "products": (("transactions", "productId", "transactionCount"),),
    "warehouses": (("products", "warehouseId", "productCount"), ("transactions", "warehouseId", "transactionCount")),
    "locations": (("products", "locationId", "productCount"),),
    "customers": (("invoices", "customerId", "invoiceCount"),),
}


def guarded_delete(
    tables: Mapping[str, DataFrame], entity: str, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new version without the deletable ids, rejected ids with the counts that hold them)."""
    asked = ids.select("id").distinct()
    counts = [count for _, _, count in GUARDS[entity]]
    for table, foreign_key, count in GUARDS[entity]:
        # Grouped before the join: a parent with most of the children is then one row in it.
        children = only_keys_of(tables[table].select(F.col(foreign_key).alias("id")), asked.select("id"), ["id"], ids)
        references = children.groupBy("id").agg(F.count("*").alias(count))
        asked = asked.join(references, "id", "left")
    asked = asked.fillna(0, subset=counts)
    free = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in counts])
    return tables[entity].join(asked.filter(free), "id", "left_anti"), asked.filter(~free)


def _without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def plain_delete(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new version without the rows of those ids, rejected ids: those the table does not have)."""
    unknown = _without(ids.select("id").distinct(), table, "id").withColumn("reject_reason", F.lit(UNKNOWN_ID))
    return _without(table, ids, "id"), unknown


def cascade_delete(
    invoices: DataFrame, items: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, items, rejected ids): the invoices of those ids go, with their items."""
    kept, unknown = plain_delete(invoices, ids)
    return kept, _without(items, ids, "invoiceId"), unknown


def latest_plan_status(plans: DataFrame, progress: DataFrame) -> DataFrame:
    """Plans with status and time of their newest progress entry, if they have one."""
    newest = progress.groupBy(F.col("planId").alias("_plan")).agg(
        F.max(F.struct("updatedAt", "id", "status")).alias("_new")
    )
    joined = plans.join(newest, F.col("id") == F.col("_plan"), "left")
    overwritten: dict[str, Column] = {"status": F.coalesce("_new.status", "status")}
    if "updatedAt" in plans.columns:
        overwritten["updatedAt"] = F.coalesce("_new.updatedAt", "updatedAt")
    return joined.withColumns(overwritten).drop("_plan", "_new")


def documents_to_ledger(documents: DataFrame, products: DataFrame) -> DataFrame:
    """Ledger rows of stock slips: one per line, at catalog price.

    Lines are numbered from 0 over the whole slip. Slips in parts (``part``, ``partCount``) go on where the parts before
    end; only the sizes of the parts of long slips meet for that.
    """
    head = ("id", "type", "code", "warehouseId", "createdAt")
    first = F.lit(0).cast("bigint")
    if "part" in documents.columns:
        before = Window.partitionBy("_slip").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = documents.filter("partCount > 1").select(
            F.col("id").alias("_slip"), F.col("part").alias("_part"), F.size("lines").cast("bigint").alias("_size")
        )
        starts = sizes.select("_slip", "_part", F.sum("_size").over(before).alias("_first"))
        met = (F.col("id") == F.col("_slip")) & (F.col("part") == F.col("_part"))
        documents = documents.join(starts, met, "left")
        first = F.coalesce("_first", first)
    lines = documents.select(*head, first.alias("_first"), F.posexplode("lines").alias("_at", "line"))
    lines = lines.withColumn("lineNo", F.col("_first") + F.col("_at"))
    kind = F.when(F.col("type") == "IN", "inbound").otherwise("outbound")
    rows = lines.select(
        F.concat_ws("-", "id", "lineNo").alias("id"),
        kind.alias("type"),
        F.col("line.productId").alias("productId"),
        "warehouseId",
        F.col("line.qty").alias("quantity"),
        F.col("code").alias("reference"),
        F.col("createdAt").alias("transactionDate"),
    )
    return lookup(rows, products, "productId", unitPrice="unitPrice")


def resolve_key(rows: DataFrame, dimension: DataFrame, code: str, by: str, name: str) -> DataFrame:
    """Replace a code column by the id of its dimension row; rows without one are dropped."""
    ids = dimension.select(F.col(by).alias(code), F.col("id").alias(name))
    return rows.join(ids, code).drop(code)


def resolve_products(
    rows: DataFrame, uoms: DataFrame, warehouses: DataFrame, locations: DataFrame, mode: str = "reference"
) -> DataFrame:
    """Products given by unit, warehouse and location code.

    Location codes repeat between warehouses. In reference mode the first location with the
    code is taken, whatever its warehouse; in exact mode it has to be in the product's.
    """
    rows = resolve_key(rows, uoms, "uomCode", "code", "uomId")
    rows = resolve_key(rows, warehouses, "warehouseCode", "code", "warehouseId")
    keys = ["locationCode"] if mode == "reference" else ["locationCode", "warehouseId"]
    first = (
        locations.withColumnRenamed("code", "locationCode").groupBy(*keys).agg(F.min("id").alias("locationId"))
    )
    return rows.join(first, keys).drop("locationCode")
