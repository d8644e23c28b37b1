"""Declared schemas: one StructType per relational table or document collection."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _struct(**columns: str) -> T.StructType:
    """Column names and Spark type names; every column is nullable."""
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


# Names and types of the tables' columns.
WAREHOUSES = _struct(
    id="bigint",
    name="string",
    code="string",
    address="string",
    city="string",
    country="string",
    phone="string",
    email="string",
    manager="string",
    totalArea="double",
    usedArea="double",
    status="string",
    type="string",
    rentalPrice="double",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
LOCATIONS = _struct(
    id="bigint",
    warehouseId="bigint",
    code="string",
    name="string",
    type="string",
    area="double",
    capacity="double",
    status="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
UOMS = _struct(
    id="bigint",
    name="string",
    code="string",
    description="string",
    isActive="boolean",
)
PRODUCTS = _struct(
    id="bigint",
    name="string",
    sku="string",
    description="string",
    manufacturer="string",
    category="string",
    uomId="bigint",
    warehouseId="bigint",
    locationId="bigint",
    minStock="double",
    maxStock="double",
    unitPrice="double",
    notes="string",
    isActive="boolean",
    createdAt="timestamp",
    updatedAt="timestamp",
)
TRANSACTIONS = _struct(
    id="bigint",
    type="string",
    productId="bigint",
    warehouseId="bigint",
    locationId="bigint",
    quantity="double",
    unitPrice="double",
    supplier="string",
    customer="string",
    reference="string",
    notes="string",
    transactionDate="timestamp",
    createdAt="timestamp",
    updatedAt="timestamp",
)
CUSTOMERS = _struct(
    id="bigint",
    name="string",
    code="string",
    contactPerson="string",
    phone="string",
    email="string",
    address="string",
    city="string",
    country="string",
    taxCode="string",
    creditLimit="double",
    status="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
INVOICES = _struct(
    id="bigint",
    invoiceNumber="string",
    customerId="bigint",
    invoiceDate="date",
    dueDate="date",
    subtotal="double",
    taxRate="double",
    taxAmount="double",
    total="double",
    status="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
INVOICE_ITEMS = _struct(
    id="bigint",
    invoiceId="bigint",
    productId="bigint",
    quantity="double",
    unitPrice="double",
    total="double",
    notes="string",
)
MAINTENANCE_PLANS = _struct(
    id="bigint",
    warehouseId="bigint",
    title="string",
    description="string",
    type="string",
    priority="string",
    plannedDate="date",
    estimatedDuration="int",
    estimatedCost="double",
    responsibleStaff="string",
    status="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
MAINTENANCE_PROGRESS = _struct(
    id="bigint",
    planId="bigint",
    status="string",
    progressPercent="int",
    actualStartDate="date",
    actualEndDate="date",
    actualCost="double",
    notes="string",
    updatedBy="string",
    updatedAt="timestamp",
)
# ``notes`` is declared although the original table lacks it: its writers set it.
INCIDENTS = _struct(
    id="bigint",
    warehouseId="bigint",
    title="string",
    description="string",
    type="string",
    severity="string",
    reportedAt="timestamp",
    reporter="string",
    phone="string",
    status="string",
    action="string",
    resolvedAt="timestamp",
    resolvedBy="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
MAINTENANCE_STAFF = _struct(
    id="bigint",
    name="string",
    code="string",
    position="string",
    specialty="string",
    phone="string",
    email="string",
    status="string",
    notes="string",
    createdAt="timestamp",
    updatedAt="timestamp",
)
SKUS = _struct(
    id="string",
    productId="string",
    skuCode="string",
    barcode="string",
    isDefault="boolean",
)
CONTRACTS = _struct(
    id="string",
    code="string",
    customerCode="string",
    customerName="string",
    type="string",
    value="double",
    startDate="string",
    endDate="string",
    status="string",
    description="string",
)

# Browser documents: one row per stock slip, its lines nested.
DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("warehouseId", T.StringType()),
        T.StructField(
            "lines",
            T.ArrayType(
                T.StructType(
                    [T.StructField("productId", T.StringType()), T.StructField("qty", T.DoubleType())]
                )
            ),
        ),
        T.StructField("createdAt", T.TimestampType()),
    ]
)

TABLES = {
    "warehouses": WAREHOUSES,
    "locations": LOCATIONS,
    "uoms": UOMS,
    "products": PRODUCTS,
    "transactions": TRANSACTIONS,
    "customers": CUSTOMERS,
    "invoices": INVOICES,
    "invoice_items": INVOICE_ITEMS,
    "maintenance_plans": MAINTENANCE_PLANS,
    "maintenance_progress": MAINTENANCE_PROGRESS,
    "incidents": INCIDENTS,
    "maintenance_staff": MAINTENANCE_STAFF,
    "skus": SKUS,
    "contracts": CONTRACTS,
    "documents": DOCUMENTS,
}
