"""DuckDB SQL for the registered queries.

Written as literally as possible (row-level joins of all children, correlated look-ups), not
after the Spark plans. Sums are taken over decimals so that row order cannot change them.
"""

from __future__ import annotations

import re


def dsum(amount: str) -> str:
    return f"CAST(sum(CAST({amount} AS DECIMAL(18,2))) AS DOUBLE)"


def dsum0(amount: str) -> str:
    return f"coalesce({dsum(amount)}, 0)"


def case_in(kind: str, amount: str) -> str:
    return f"CASE WHEN t.type = '{kind}' THEN {amount} ELSE 0 END"


def pct(part: str, whole: str, factor: str = "100") -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part}) / ({whole}) * {factor}, 2) ELSE 0.0 END"


IN_QTY, OUT_QTY = dsum0(case_in("inbound", "t.quantity")), dsum0(case_in("outbound", "t.quantity"))
IN_VAL, OUT_VAL = dsum0(case_in("inbound", "t.lineValue")), dsum0(case_in("outbound", "t.lineValue"))
SIGNED = "CASE WHEN t.type = 'inbound' THEN t.quantity ELSE -t.quantity END"
ON_HAND = dsum0(SIGNED)
DAY = "strftime(t.transactionDate, '%Y-%m-%d')"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
T_DATE = STAMP.format("t.transactionDate") + " AS transactionDate"
VALUE_SUM = dsum("t.lineValue")
QTY_SUM = dsum("t.quantity")

CTES = {
    "wh": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, concat('W', n_nationkey) AS code,
        CAST(n_nationkey*100 AS DOUBLE) AS totalArea, CAST(n_nationkey*(n_nationkey % 7)*10 AS DOUBLE) AS usedArea,
        CAST(50000+1000*n_nationkey AS DOUBLE) AS rentalPrice,
        CASE WHEN n_nationkey % 3 = 0 THEN 'cold' ELSE 'general' END AS type FROM nation""",
    "loc": """SELECT CAST(n_nationkey*4+slot AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS warehouseId,
        concat('L', slot) AS code, concat('Slot ', slot) AS name,
        CASE WHEN slot < 2 THEN 'storage' ELSE 'picking' END AS type,
        CAST(25*(slot+1) AS DOUBLE) AS area, CAST(40*slot AS DOUBLE) AS capacity,
        CASE (n_nationkey+slot) % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'occupied'
            WHEN 2 THEN 'full' ELSE 'maintenance' END AS status
        FROM nation CROSS JOIN (VALUES (0),(1),(2),(3)) AS s(slot) WHERE n_nationkey < 24""",
    "uom": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, concat('U', r_regionkey) AS code FROM region",
    "prod": """SELECT p_partkey AS id, p_name AS name, concat('SKU-', p_partkey) AS sku,
        concat(p_name, ' ', p_type) AS description, p_type AS category, p_brand AS manufacturer,
        p_partkey % 6 AS uomId,
        CASE WHEN p_partkey % 25 = 23 THEN NULL ELSE p_partkey % 25 END AS warehouseId,
        CASE WHEN p_partkey % 25 < 23 THEN (p_partkey % 25)*4 + CAST(floor(p_partkey/25) AS BIGINT) % 3 END AS locationId,
        CAST(p_size AS DOUBLE)/2 AS minStock, CAST(p_size AS DOUBLE)*4 AS maxStock, p_retailprice AS unitPrice
        FROM part""",
    "led": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id,
        CASE WHEN l_returnflag='A' OR (l_returnflag='N' AND l_linestatus='F') THEN 'inbound'
            WHEN l_returnflag='N' THEN 'outbound'
            WHEN l_linestatus='F' THEN 'transfer' ELSE 'adjustment' END AS type,
        l_partkey AS productId, l_suppkey % 25 AS warehouseId,
        CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 25 < 24 THEN (l_suppkey % 25)*4 END AS locationId,
        l_quantity AS quantity, l_extendedprice/l_quantity AS unitPrice, l_extendedprice AS lineValue,
        concat(CASE l_linenumber WHEN 1 THEN 'TR-' WHEN 2 THEN 'ADJ-' WHEN 3 THEN 'ST-' ELSE 'PO-' END, l_orderkey)
            AS reference,
        l_returnflag AS notes, l_shipdate AS transactionDate, c_name AS customer
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
    "cust": """SELECT c_custkey AS id, c_name AS name, concat('C-', c_custkey) AS code, c_mktsegment AS contactPerson,
        concat('09', c_custkey) AS phone, concat('c', c_custkey, '@example.com') AS email, c_acctbal AS creditLimit,
        CASE WHEN c_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status FROM customer""",
    "inv": """SELECT o_orderkey AS id, concat('INV-', o_orderkey) AS invoiceNumber, o_custkey AS customerId,
        CAST(o_orderdate AS DATE) AS invoiceDate, o_totalprice AS total,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS status FROM orders""",
    "item": """SELECT l_orderkey AS invoiceId, l_partkey AS productId, l_linenumber AS lineNo, l_quantity AS quantity,
        l_extendedprice/l_quantity AS unitPrice, l_extendedprice AS total FROM lineitem""",
    "doc": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN 'IN' ELSE 'OUT' END AS type,
        concat(CASE WHEN o_orderkey % 5 < 3 THEN 'PN-' ELSE 'PX-' END, o_orderkey) AS code,
        o_orderkey % 25 AS warehouseId, o_orderdate AS createdAt FROM orders""",
    "dline": """SELECT doc.id AS documentId, doc.type, doc.warehouseId, doc.createdAt, l_partkey AS productId,
        l_quantity AS qty, CASE WHEN doc.type = 'IN' THEN l_quantity ELSE -l_quantity END AS signedQty
        FROM doc JOIN lineitem ON l_orderkey = doc.id""",
    "dstock": """SELECT prod.*, coalesce((SELECT CAST(sum(CAST(signedQty AS DECIMAL(18,2))) AS DOUBLE) FROM dline
        WHERE dline.productId = prod.id), 0) AS onHand FROM prod""",
    "plan": """SELECT event_id AS id, user_id % 25 AS warehouseId, concat('Plan ', event_id) AS title,
        CASE WHEN event_type='view' THEN 'preventive' ELSE 'corrective' END AS type,
        CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
        CAST(ts AS DATE) AS plannedDate, CAST(1 + event_id % 5 AS INT) AS estimatedDuration, value AS estimatedCost,
        concat('Staff ', user_id % 20) AS responsibleStaff,
        CASE event_id % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'cancelled' END
            AS status FROM events WHERE event_type IN ('view','click')""",
    "prog": """SELECT event_id AS id, event_id - event_id % 3 AS planId,
        CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'planned' ELSE 'cancelled' END
            AS status,
        CAST(event_id % 101 AS INT) AS progressPercent, value AS actualCost,
        concat('Staff ', user_id % 20) AS updatedBy, ts AS updatedAt FROM events WHERE event_type = 'purchase'""",
    "inc": """SELECT event_id AS id, user_id % 25 AS warehouseId, concat('Incident ', event_id) AS title,
        'equipment' AS type, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
        ts AS reportedAt, CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'reported' END AS status,
        CASE WHEN event_id % 2 = 0 THEN concat('Staff ', user_id % 25) END AS resolvedBy
        FROM events WHERE event_type = 'error'""",
    "staff": """SELECT DISTINCT user_id % 30 AS id, concat('Staff ', user_id % 30) AS name,
        concat('MT-', user_id % 30) AS code,
        CASE WHEN user_id % 30 % 2 = 0 THEN 'Điện tử, Cơ khí' ELSE 'Hệ thống lạnh' END AS specialty,
        CASE WHEN user_id % 30 < 28 THEN 'active' ELSE 'inactive' END AS status FROM events""",
    "contract": """SELECT concat('HD-', c_custkey) AS code, concat('C-', c_custkey % 1000) AS customerCode,
        c_name AS customerName, c_acctbal AS value,
        strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT), '%Y-%m-%d') AS startDate,
        strftime(DATE '2024-06-01' + CAST(c_custkey % 300 AS INT), '%Y-%m-%d') AS endDate,
        CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' ELSE 'pending' END AS status,
        concat('Contract ', c_mktsegment) AS description FROM customer""",
    "invdoc": """SELECT concat('INV-', o_orderkey) AS code, concat('C-', o_custkey) AS customerCode,
        c_name AS customerName, CASE WHEN o_orderkey % 2 = 0 THEN 'Nhập' ELSE 'Xuất' END AS type,
        o_totalprice AS totalWithTax, strftime(o_orderdate, '%Y-%m-%d') AS issueDate,
        strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS dueDate,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS status,
        concat('Order ', o_orderpriority) AS description
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    # Warehouse joined with all products, locations and ledger rows at once.
    "fan": """SELECT w.id, w.name, w.code, w.totalArea, w.usedArea, p.id AS pid, l.id AS lid, t.type, t.quantity,
        t.lineValue, t.transactionDate FROM wh w LEFT JOIN prod p ON w.id = p.warehouseId
        LEFT JOIN loc l ON w.id = l.warehouseId LEFT JOIN led t ON w.id = t.warehouseId""",
    "fan_week": """SELECT w.id, w.name, w.code, w.totalArea, w.usedArea, p.id AS pid, l.id AS lid, t.type, t.quantity,
        t.lineValue, t.transactionDate FROM wh w LEFT JOIN prod p ON w.id = p.warehouseId
        LEFT JOIN loc l ON w.id = l.warehouseId LEFT JOIN led t ON w.id = t.warehouseId
        AND CAST(t.transactionDate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-07'""",
    # The same without siblings: child counts by sub-query.
    "single": """SELECT w.id, w.name, w.code, w.totalArea, w.usedArea,
        (SELECT count(*) FROM prod p WHERE p.warehouseId = w.id) AS products,
        (SELECT count(*) FROM loc l WHERE l.warehouseId = w.id) AS locations,
        t.type, t.quantity, t.lineValue FROM wh w LEFT JOIN led t ON w.id = t.warehouseId""",
    "bykey": f"SELECT t.productId, t.warehouseId, {ON_HAND} AS onHand FROM led t GROUP BY ALL",
    "valued": """SELECT l.*, count(p.id) AS productCount,
        coalesce(CAST(sum(CAST(p.unitPrice * coalesce((SELECT k.onHand FROM bykey k WHERE k.productId = p.id
            AND k.warehouseId = l.warehouseId), 0) AS DECIMAL(20,4))) AS DOUBLE), 0) AS inventoryValue
        FROM loc l LEFT JOIN prod p ON l.id = p.locationId
        GROUP BY l.id, l.warehouseId, l.code, l.name, l.type, l.area, l.capacity, l.status""",
    "udoc": """SELECT *, CASE WHEN invoiceNumber = '' THEN 'invoiceNumber is missing'
            WHEN id NOT IN (SELECT id FROM inv) THEN 'id is not known'
            WHEN EXISTS (SELECT 1 FROM inv i WHERE i.invoiceNumber = n.invoiceNumber AND i.id <> n.id) THEN 'invoiceNumber exists' END AS reason
        FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS id,
            CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN concat('INV-', o_orderkey - 1)
                ELSE concat('UPD-', o_orderkey) END AS invoiceNumber,
            o_custkey + 1 AS customerId, CAST(o_orderdate AS DATE) AS invoiceDate,
            CASE WHEN o_custkey % 2 = 0 THEN 8.0 ELSE 0.0 END::DOUBLE AS taxRate, o_custkey, o_totalprice,
            CAST(CAST(2 * o_totalprice AS DECIMAL(18,2)) + 30.75 AS DOUBLE) AS subtotal FROM orders) n""",
}

HOME_JOIN = "LEFT JOIN led t ON p.id = t.productId AND p.warehouseId = t.warehouseId"
PRODUCT_HEAD = """p.id, p.name AS productName, p.sku, p.category, p.manufacturer, p.minStock, p.maxStock, p.unitPrice,
    w.name AS warehouseName, l.name AS locationName"""
PRODUCT_GROUP = """p.id, p.name, p.sku, p.category, p.manufacturer, p.minStock, p.maxStock, p.unitPrice,
    w.name, l.name, p.warehouseId"""


def status(low: str = "minStock", high: str = "maxStock") -> str:
    return f"CASE WHEN onHand <= {low} THEN 'low' WHEN onHand >= {high} THEN 'high' ELSE 'normal' END AS stockStatus"


BY_PRODUCT = f"""SELECT *, {status()} FROM (
    SELECT {PRODUCT_HEAD}, {IN_QTY} AS totalIn, {OUT_QTY} AS totalOut, {ON_HAND} AS onHand, {IN_VAL} AS inventoryValue
    FROM prod p LEFT JOIN wh w ON p.warehouseId = w.id LEFT JOIN loc l ON p.locationId = l.id {HOME_JOIN}
    GROUP BY {PRODUCT_GROUP})"""

LOW_STOCK = f"""SELECT *, CASE WHEN onHand <= minStock THEN 'critical' ELSE 'warning' END AS alertLevel,
    minStock - onHand AS shortage, (minStock - onHand) * unitPrice AS shortageValue FROM (
    SELECT {PRODUCT_HEAD}, {ON_HAND} AS onHand
    FROM prod p LEFT JOIN wh w ON p.warehouseId = w.id LEFT JOIN loc l ON p.locationId = l.id {HOME_JOIN}
    GROUP BY {PRODUCT_GROUP}) WHERE onHand <= minStock * 1.5"""


def overview(where: str = "") -> str:
    return f"""SELECT *, totalInboundValue - totalOutboundValue AS netInventoryValue,
        totalInboundQuantity - totalOutboundQuantity AS netInventoryQuantity,
        {pct('totalOutboundQuantity', 'totalInboundQuantity')} AS turnoverRate FROM (
        SELECT (SELECT count(*) FROM wh) AS totalWarehouses, (SELECT count(*) FROM prod) AS totalProducts,
            (SELECT count(*) FROM cust) AS totalCustomers, count(*) AS totalTransactions,
            count(DISTINCT CAST(t.transactionDate AS DATE)) AS activeDays,
            {IN_VAL} AS totalInboundValue, {OUT_VAL} AS totalOutboundValue,
            {IN_QTY} AS totalInboundQuantity, {OUT_QTY} AS totalOutboundQuantity FROM led t {where})"""


IN_YEAR = "CAST(t.transactionDate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"


def timeline(where: str = "") -> str:
    return f"""SELECT {DAY} AS date, t.type, count(*) AS transactionCount, {QTY_SUM} AS totalQuantity,
        {VALUE_SUM} AS totalValue, count(DISTINCT t.productId) AS uniqueProducts,
        count(DISTINCT t.warehouseId) AS uniqueWarehouses FROM led t {where} GROUP BY ALL"""


def transfers(where: str = "") -> str:
    """Per leg its place in the order newest first, ties by id; then the states in that order."""
    return f"""WITH legs AS (
        SELECT t.*, w.name AS warehouseName, p.name AS product, p.sku,
            row_number() OVER (PARTITION BY t.reference ORDER BY t.transactionDate DESC, t.id) AS place
        FROM led t LEFT JOIN prod p ON t.productId = p.id LEFT JOIN wh w ON t.warehouseId = w.id
        WHERE t.reference LIKE 'TR-%' {where}),
    ends AS (SELECT reference,
            max(place) FILTER (WHERE type = 'outbound') AS lastOut, max(place) FILTER (WHERE type = 'inbound') AS lastIn
        FROM legs GROUP BY reference)
    SELECT h.reference, {STAMP.format('h.transactionDate')} AS date, h.product, h.sku, h.quantity,
        h.unitPrice, h.notes, o.warehouseName AS fromWarehouse, i.warehouseName AS toWarehouse,
        CASE WHEN lastOut IS NULL THEN 'pending' WHEN lastIn > lastOut AND o.warehouseName IS NOT NULL THEN 'completed'
            ELSE 'in_progress' END AS status
    FROM legs h JOIN ends e USING (reference)
    LEFT JOIN legs o ON o.reference = e.reference AND o.place = e.lastOut
    LEFT JOIN legs i ON i.reference = e.reference AND i.place = e.lastIn WHERE h.place = 1"""


ENTRY = f"""t.id, t.reference, {T_DATE}, t.quantity, t.notes, p.name AS productName, p.sku, w.name AS warehouseName,
    l.name AS locationName"""
ENTRY_FROM = """FROM led t LEFT JOIN prod p ON t.productId = p.id LEFT JOIN wh w ON t.warehouseId = w.id
    LEFT JOIN loc l ON t.locationId = l.id"""
ADJUSTMENT = f"""SELECT {ENTRY}, CASE WHEN t.quantity > 0 THEN 'Tăng' ELSE 'Giảm' END AS adjustmentType,
    abs(t.quantity) AS absoluteQuantity {ENTRY_FROM} WHERE t.reference LIKE 'ADJ-%'"""


def revenue(period: str, where: str = "") -> str:
    return f"""SELECT strftime(t.transactionDate, '{period}') AS period, count(*) AS transactionCount,
        {QTY_SUM} AS totalQuantity, {VALUE_SUM} AS totalRevenue, count(DISTINCT t.productId) AS uniqueProducts,
        {VALUE_SUM} / count(*) AS averageOrderValue
        FROM led t WHERE t.type = 'outbound' {where} GROUP BY 1"""


def top_products(order: str, limit: int) -> str:
    return f"""SELECT * EXCLUDE (wid) FROM (
        SELECT p.id, p.name AS productName, p.sku, p.category, p.manufacturer, w.name AS warehouseName, w.id AS wid,
            count(*) AS transactionCount, {QTY_SUM} AS totalQuantity, {VALUE_SUM} AS totalRevenue,
            round(avg(t.unitPrice), 6) AS averagePrice
        FROM led t LEFT JOIN prod p ON t.productId = p.id LEFT JOIN wh w ON t.warehouseId = w.id
        WHERE t.type = 'outbound' GROUP BY p.id, p.name, p.sku, p.category, p.manufacturer, w.name, w.id)
        ORDER BY {order} DESC, id, wid LIMIT {limit}"""


def activity(source: str, names: dict[str, str]) -> str:
    """Sums over the joined children; ``names`` maps measure -> output column."""
    counts = (
        "any_value(products) AS totalProducts, any_value(locations) AS totalLocations"
        if source == "single"
        else "count(DISTINCT pid) AS totalProducts, count(DISTINCT lid) AS totalLocations"
    )
    measures = {
        "in_n": "count(CASE WHEN t.type = 'inbound' THEN 1 END)",
        "out_n": "count(CASE WHEN t.type = 'outbound' THEN 1 END)",
        "tr_n": "count(CASE WHEN t.type = 'transfer' THEN 1 END)",
        "in_q": IN_QTY, "out_q": OUT_QTY, "in_v": IN_VAL, "out_v": OUT_VAL,
    }
    chosen = ", ".join(f"{measures[m]} AS {c}" for m, c in names.items())
    return f"""SELECT id, any_value(name) AS warehouseName, any_value(code) AS warehouseCode,
        any_value(totalArea) AS totalArea, any_value(usedArea) AS usedArea, {counts}, {chosen}
        FROM {source} t GROUP BY id"""


PERFORMANCE = {
    "in_n": "inboundTransactions", "out_n": "outboundTransactions", "tr_n": "transferTransactions",
    "in_q": "totalInboundQuantity", "out_q": "totalOutboundQuantity",
    "in_v": "totalInboundValue", "out_v": "totalOutboundValue",
}
EFFICIENCY = {
    "in_n": "inboundCount", "out_n": "outboundCount", "in_q": "inboundQuantity", "out_q": "outboundQuantity",
    "in_v": "inboundValue", "out_v": "outboundValue",
}


def performance(source: str) -> str:
    return f"""SELECT *, {pct('usedArea', 'totalArea')} AS utilizationRate,
        inboundTransactions + outboundTransactions + transferTransactions AS totalTransactions,
        totalInboundValue - totalOutboundValue AS netInventoryValue,
        {pct('totalOutboundQuantity', 'totalInboundQuantity')} AS turnoverRate,
        totalInboundQuantity - totalOutboundQuantity AS netInventoryQuantity
        FROM ({activity(source, PERFORMANCE)})"""


def efficiency(source: str) -> str:
    return f"""SELECT *, {pct('usedArea', 'totalArea')} AS utilizationRate,
        inboundCount + outboundCount AS totalTransactions,
        {pct('outboundQuantity', 'inboundQuantity')} AS turnoverRate,
        {pct('inboundValue', 'totalArea', '1')} AS valueEfficiency,
        {pct('totalProducts', 'totalArea', '1')} AS productDensity FROM ({activity(source, EFFICIENCY)})"""


def trends(period: int, value: str) -> str:
    return f"""SELECT date, value, transactionCount, uniqueProducts, change,
        CASE WHEN change > 0 THEN 'increase' WHEN change < 0 THEN 'decrease' ELSE 'stable' END AS changeType FROM (
        SELECT *, CASE WHEN previous > 0 THEN round((value - previous) / previous * 100, 2) ELSE 0.0 END AS change FROM (
            SELECT *, lag(value) OVER (ORDER BY date) AS previous FROM (
                SELECT {DAY} AS date, {value} AS value, count(*) AS transactionCount,
                    count(DISTINCT t.productId) AS uniqueProducts FROM led t
                WHERE t.transactionDate >= (SELECT CAST(max(transactionDate) AS DATE) FROM led) - {period} GROUP BY 1)))"""


def storage_cost(where: str = "") -> str:
    return f"""SELECT *, totalArea * rentalPrice AS monthlyRent, inventoryValue * 0.02::DOUBLE AS inventoryCost,
        totalArea * rentalPrice + inventoryValue * 0.02::DOUBLE AS totalMonthlyCost,
        {pct('totalArea * rentalPrice + inventoryValue * 0.02', 'totalArea', '1')} AS costPerSqm FROM (
        SELECT w.id, w.name AS warehouseName, w.code AS warehouseCode, w.totalArea, w.usedArea, w.rentalPrice,
            {IN_VAL} AS inventoryValue, {ON_HAND} AS totalQuantity, {pct('w.usedArea', 'w.totalArea')} AS utilizationRate
        FROM wh w LEFT JOIN prod p ON w.id = p.warehouseId
        LEFT JOIN led t ON p.id = t.productId AND w.id = t.warehouseId {where}
        GROUP BY w.id, w.name, w.code, w.totalArea, w.usedArea, w.rentalPrice)"""


LEDGER_COLUMNS = f"""t.id, t.type, t.productId, t.warehouseId, t.locationId, t.quantity,
    t.unitPrice, t.reference, t.notes, {T_DATE}"""
LEDGER_LIST = f"""SELECT {LEDGER_COLUMNS}, p.name AS productName, p.sku AS productSku, w.name AS warehouseName,
    l.name AS locationName, u.name AS uomName {ENTRY_FROM} LEFT JOIN uom u ON p.uomId = u.id"""
SUMMARY_SUMS = [dsum(case_in(k, a)) for k, a in (
    ("inbound", "t.quantity"), ("outbound", "t.quantity"), ("inbound", "t.lineValue"), ("outbound", "t.lineValue"))]

STOCK = f"{IN_QTY} AS totalIn, {OUT_QTY} AS totalOut, {ON_HAND} AS onHand"
PRODUCT_COLUMNS = """p.id, p.name, p.sku, p.description, p.category, p.manufacturer, p.uomId, p.warehouseId,
    p.locationId, p.minStock, p.maxStock, p.unitPrice"""
PRODUCT_LIST = f"""SELECT {PRODUCT_COLUMNS}, u.name AS uomName, w.name AS warehouseName, l.name AS locationName
    FROM prod p LEFT JOIN uom u ON p.uomId = u.id LEFT JOIN wh w ON p.warehouseId = w.id
    LEFT JOIN loc l ON p.locationId = l.id"""
WAREHOUSE_PRODUCTS = f"""SELECT *, {status()} FROM (
    SELECT {PRODUCT_COLUMNS}, u.name AS uomName, l.name AS locationName, {STOCK}
    FROM prod p LEFT JOIN uom u ON p.uomId = u.id LEFT JOIN loc l ON p.locationId = l.id {HOME_JOIN}
    WHERE p.warehouseId IS NOT NULL GROUP BY {PRODUCT_COLUMNS}, u.name, l.name)"""
WH_COLUMNS = "w.id, w.name, w.code, w.totalArea, w.usedArea, w.rentalPrice, w.type"


def warehouse_list(value: str) -> str:
    return f"""SELECT {WH_COLUMNS}, count(DISTINCT l.id) AS totalLocations, count(DISTINCT p.id) AS totalProducts,
        coalesce({value}, 0) AS totalInventoryValue
        FROM wh w LEFT JOIN loc l ON w.id = l.warehouseId LEFT JOIN prod p ON w.id = p.warehouseId
        GROUP BY {WH_COLUMNS}"""


CATALOG_VALUE = """CAST(p.unitPrice * coalesce((SELECT k.onHand FROM bykey k WHERE k.productId = p.id
    AND k.warehouseId = w.id), 0) AS DECIMAL(20,4))"""
# One warehouse at a time: a product's term once, not once per location.
CATALOG_VALUE_ONCE = """(SELECT CAST(sum(CAST(q.unitPrice * k.onHand AS DECIMAL(20,4))) AS DOUBLE) FROM prod q JOIN bykey k
    ON k.productId = q.id AND k.warehouseId = w.id WHERE q.warehouseId = w.id)"""
WAREHOUSE_STATS = f"""SELECT id, warehouseName, totalArea, usedArea, totalLocations, totalProducts, totalInbound,
    totalOutbound, totalInboundValue, totalOutboundValue, {pct('usedArea', 'totalArea')} AS utilizationRate,
    totalInbound - totalOutbound AS netInventory, totalInboundValue - totalOutboundValue AS netValue FROM (
    {activity('fan', {'in_q': 'totalInbound', 'out_q': 'totalOutbound', 'in_v': 'totalInboundValue',
                      'out_v': 'totalOutboundValue'})})"""


def location_stats(source: str) -> str:
    return f"""SELECT *, {pct('totalProducts', 'totalCapacity')} AS utilizationRate,
        coalesce(totalCapacity, 0) - totalProducts AS availableCapacity FROM (
        SELECT w.id, w.name AS warehouseName, w.code AS warehouseCode, count(l.id) AS totalLocations,
            count(CASE WHEN l.status = 'available' THEN 1 END) AS availableLocations,
            count(CASE WHEN l.status = 'occupied' THEN 1 END) AS occupiedLocations,
            count(CASE WHEN l.status = 'full' THEN 1 END) AS fullLocations,
            count(CASE WHEN l.status = 'maintenance' THEN 1 END) AS maintenanceLocations,
            {dsum('l.area')} AS totalArea, {dsum('l.capacity')} AS totalCapacity, {source}
        GROUP BY w.id, w.name, w.code)"""


CUSTOMERS = f"""SELECT c.id, c.name, c.code, c.contactPerson, c.phone, c.email, c.creditLimit, c.status,
    count(DISTINCT i.id) AS totalInvoices, {dsum0('i.total')} AS totalRevenue
    FROM cust c LEFT JOIN inv i ON c.id = i.customerId {{}}
    GROUP BY c.id, c.name, c.code, c.contactPerson, c.phone, c.email, c.creditLimit, c.status"""
INVOICES = f"""SELECT i.id, i.invoiceNumber, i.customerId, strftime(i.invoiceDate, '%Y-%m-%d') AS invoiceDate, i.total,
    i.status, c.name AS customerName, c.code AS customerCode, count(ii.invoiceId) AS itemCount,
    {dsum('ii.total')} AS calculatedTotal
    FROM inv i LEFT JOIN cust c ON i.customerId = c.id LEFT JOIN item ii ON i.id = ii.invoiceId {{}}
    GROUP BY i.id, i.invoiceNumber, i.customerId, i.invoiceDate, i.total, i.status, c.name, c.code"""
INVOICE_SUMMARY = f"""SELECT count(*) AS totalInvoices, count(CASE WHEN status = 'paid' THEN 1 END) AS paidInvoices,
    count(CASE WHEN status = 'pending' THEN 1 END) AS pendingInvoices,
    count(CASE WHEN status = 'overdue' THEN 1 END) AS overdueInvoices, {dsum('total')} AS totalRevenue,
    {dsum('total')} / count(*) AS averageInvoiceValue,
    strftime(min(invoiceDate), '%Y-%m-%d') AS firstInvoiceDate, strftime(max(invoiceDate), '%Y-%m-%d') AS lastInvoiceDate
    FROM inv"""
MONTHLY = f"""SELECT strftime(invoiceDate, '%m') AS month, count(*) AS invoiceCount, {dsum('total')} AS totalRevenue,
    {dsum('total')} / count(*) AS averageRevenue FROM inv WHERE year(invoiceDate) = {{}} GROUP BY 1"""

PLAN_COLUMNS = """m.id, m.warehouseId, m.title, m.type, m.priority, strftime(m.plannedDate, '%Y-%m-%d') AS plannedDate,
    m.estimatedDuration, m.estimatedCost, m.responsibleStaff"""


def plan_stats(where: str = "") -> str:
    counted = {
        "plannedPlans": "status = 'planned'", "inProgressPlans": "status = 'in_progress'",
        "completedPlans": "status = 'completed'", "cancelledPlans": "status = 'cancelled'",
        "preventivePlans": "type = 'preventive'", "correctivePlans": "type = 'corrective'",
        "highPriorityPlans": "priority = 'high'", "mediumPriorityPlans": "priority = 'medium'",
        "lowPriorityPlans": "priority = 'low'",
    }
    columns = ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in counted.items())
    return f"""SELECT * REPLACE (round(averageDuration, 1) AS averageDuration),
        {pct('completedPlans', 'totalPlans')} AS completionRate FROM (
        SELECT count(*) AS totalPlans, {columns}, {dsum('estimatedCost')} AS totalPlannedCost,
            avg(estimatedDuration) AS averageDuration FROM plan {where})"""


LAST_SLIP = "(SELECT max(createdAt) FROM doc)"


def top_moved(kind: str) -> str:
    return f"""SELECT productId, quantity, coalesce(p.sku, '?') AS code FROM (
        SELECT productId, {dsum('qty')} AS quantity FROM dline
        WHERE type = '{kind}' AND createdAt >= {LAST_SLIP} - INTERVAL 29 DAY GROUP BY 1) m
        LEFT JOIN prod p ON p.id = m.productId ORDER BY quantity DESC, productId LIMIT 5"""


def movement(where: str = "") -> str:
    return f"""SELECT id, code, name, inQty, outQty, inQty - outQty AS balance FROM (
        SELECT p.id, p.sku AS code, p.name, {dsum0("CASE WHEN d.type = 'IN' THEN d.qty ELSE 0 END")} AS inQty,
            {dsum0("CASE WHEN d.type = 'IN' THEN 0 ELSE d.qty END")} AS outQty
        FROM prod p LEFT JOIN (SELECT * FROM dline {where}) d ON d.productId = p.id GROUP BY p.id, p.sku, p.name)"""


def grouped(amount: str) -> str:
    return f"rtrim(rtrim(format('{{:,.2f}}', {amount}), '0'), '.')"


CONTRACT_ROW = f"""SELECT 'Hợp đồng' AS kind, code, description AS name,
    concat('KH: ', customerName, ' - Giá trị: ', {grouped('value')}, 'đ') AS info,
    CASE status WHEN 'active' THEN 'Hoạt động' WHEN 'completed' THEN 'Hoàn thành' ELSE 'Chờ xử lý' END AS status
    FROM contract"""
INVOICE_ROW = f"""SELECT 'Hóa đơn' AS kind, code, description AS name,
    concat('KH: ', customerName, ' - Tổng: ', {grouped('totalWithTax')}, 'đ') AS info,
    CASE status WHEN 'paid' THEN 'Đã thanh toán' WHEN 'overdue' THEN 'Quá hạn' ELSE 'Chờ thanh toán' END AS status
    FROM invdoc"""
CUSTOMER_ROW = """SELECT 'Khách hàng' AS kind, code, name, concat('Liên hệ: ', contactPerson, ' - ', phone) AS info,
    CASE status WHEN 'active' THEN 'Hoạt động' ELSE 'Không hoạt động' END AS status FROM cust"""


def has(term: str, *columns: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{term}')" for c in columns) + ")"


ENTITY_SEARCH = f"""SELECT 'Sản phẩm' AS kind, sku AS code, name, 'Đơn vị: N/A' AS info, 'Hoạt động' AS status
    FROM prod WHERE {has('1', 'sku', 'name')}
    UNION ALL SELECT CASE WHEN type = 'IN' THEN 'Phiếu Nhập' ELSE 'Phiếu Xuất' END, code,
        concat((SELECT count(*) FROM lineitem WHERE l_orderkey = doc.id), ' dòng'),
        concat('Ngày: ', strftime(createdAt, '%Y-%m-%d')), 'Hoàn thành' FROM doc WHERE {has('1', 'code')}
    UNION ALL {CUSTOMER_ROW} WHERE {has('1', 'code', 'name', 'contactPerson')}
    UNION ALL {CONTRACT_ROW} WHERE {has('1', 'code', 'customerName', 'description')}
    UNION ALL {INVOICE_ROW} WHERE {has('1', 'code', 'customerName', 'description')}"""

PRODUCT_CARD = """SELECT p.id AS productId, concat('{"id":', p.id, ',"code":"', p.sku, '","name":"', p.name,
    '","uom":"Cái","barcode":"', CASE WHEN p.id % 3 <> 0 AND p.id % 5 <> 0 THEN concat('893', p.id) ELSE '' END,
    '","sku":"', CASE WHEN p.id % 3 <> 0 THEN concat('Ka', p.id) ELSE '' END,
    '","manufacturer":"', p.manufacturer, '","onHand":', CAST(greatest(0.0, p.onHand) AS DOUBLE),
    ',"lastUpdated":"2024-01-01T00:00:00.000Z","description":"', p.description, '"}') AS card FROM dstock p"""

# Requests one after the other, per product and warehouse: the balance is carried along.
def in_order(requests: str = "led") -> str:
    return f"""WITH RECURSIVE req AS (SELECT id, productId, warehouseId, quantity,
        row_number() OVER (PARTITION BY productId, warehouseId ORDER BY transactionDate, id) AS n
        FROM {requests} WHERE type IN ('outbound', 'transfer')),
    stock AS (SELECT productId, warehouseId, sum(CASE WHEN type = 'inbound' THEN quantity ELSE -quantity END) AS q
        FROM led WHERE type NOT IN ('outbound', 'transfer') GROUP BY ALL),
    posted(id, productId, warehouseId, quantity, n, available, accepted) AS (
        SELECT r.id, r.productId, r.warehouseId, r.quantity, r.n, coalesce(s.q, 0), coalesce(s.q, 0) >= r.quantity
        FROM req r LEFT JOIN stock s ON s.productId = r.productId AND s.warehouseId = r.warehouseId WHERE r.n = 1
        UNION ALL
        SELECT r.id, r.productId, r.warehouseId, r.quantity, r.n,
            CASE WHEN b.accepted THEN b.available - b.quantity ELSE b.available END,
            CASE WHEN b.accepted THEN b.available - b.quantity ELSE b.available END >= r.quantity
        FROM posted b JOIN req r ON r.productId = b.productId AND r.warehouseId = b.warehouseId AND r.n = b.n + 1)"""


POSTED = in_order()
BLANKS = """(SELECT id, type, productId, warehouseId, CASE WHEN quantity > 3 THEN quantity WHEN quantity > 2 THEN 0.0 END AS quantity,
    CASE WHEN id LIKE '%7' THEN TIMESTAMP '2024-01-01' ELSE transactionDate END AS transactionDate FROM led)"""
COMPLETE = f"(SELECT * FROM {BLANKS} WHERE quantity > 0 AND warehouseId <> 0 AND productId <> 0)"

# As above per product, with the balances of all 25 warehouses in a list.
TRANSFERRED = """WITH RECURSIVE req AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id,
            l_partkey AS productId, l_suppkey % 25 AS src, (l_suppkey + l_linenumber) % 25 AS dst, l_quantity AS quantity,
            l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY productId ORDER BY d, id) AS n FROM req WHERE src <> 0 AND dst <> 0 AND productId <> 0),
    stock AS (SELECT productId, warehouseId, sum(CASE WHEN type = 'inbound' THEN quantity ELSE -quantity END) AS q
        FROM led WHERE type <> 'transfer' GROUP BY ALL),
    grid AS (SELECT p.productId, list(coalesce(s.q, 0.0) ORDER BY w.k) AS balances
        FROM (SELECT DISTINCT productId FROM req) p CROSS JOIN (SELECT unnest(range(25)) AS k) w
        LEFT JOIN stock s ON s.productId = p.productId AND s.warehouseId = w.k GROUP BY 1),
    run(productId, n, id, src, dst, quantity, available, accepted, balances) AS (
        SELECT productId, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, false, balances
        FROM grid
        UNION ALL
        SELECT r.productId, q.n, q.id, q.src, q.dst, q.quantity, r.balances[q.src + 1], r.balances[q.src + 1] >= q.quantity,
            list_transform(r.balances, lambda b, i: CASE WHEN r.balances[q.src + 1] >= q.quantity
                THEN b - CASE WHEN i = q.src + 1 THEN q.quantity ELSE 0 END + CASE WHEN i = q.dst + 1 THEN q.quantity ELSE 0 END
                ELSE b END)
        FROM run r JOIN numbered q ON q.productId = r.productId AND q.n = r.n + 1)
    SELECT concat(id, '-out') AS id, 'outbound' AS type, productId, src AS warehouseId, quantity FROM run WHERE n > 0 AND accepted
    UNION ALL SELECT concat(id, '-in'), 'inbound', productId, dst, quantity FROM run WHERE n > 0 AND accepted
    UNION ALL SELECT id, 'rejected', productId, src, available FROM run WHERE n > 0 AND NOT accepted
    UNION ALL SELECT id, 'rejected', productId, src, NULL FROM req WHERE src = 0 OR dst = 0 OR productId = 0"""

UPSERT_CHANGES = """WITH change AS (SELECT l_partkey * 2 AS id,
        CASE WHEN l_linenumber % 3 > 0 THEN concat('Version ', l_orderkey) ELSE '' END AS name,
        concat('SKU-', l_partkey * 2) AS sku, l_extendedprice AS unitPrice, l_shipdate AS updatedAt FROM lineitem)"""
UPSERT = UPSERT_CHANGES + """,
    latest AS (SELECT * FROM change WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY id
        ORDER BY updatedAt DESC, name DESC, sku DESC, unitPrice DESC) = 1)
    SELECT coalesce(p.id, l.id) AS id, CASE WHEN l.id IS NULL THEN p.name ELSE l.name END AS name,
        CASE WHEN l.id IS NULL THEN p.sku ELSE l.sku END AS sku,
        CASE WHEN l.id IS NULL THEN p.description END AS description, CASE WHEN l.id IS NULL THEN p.category END AS category,
        CASE WHEN l.id IS NULL THEN p.manufacturer END AS manufacturer, CASE WHEN l.id IS NULL THEN p.uomId END AS uomId,
        CASE WHEN l.id IS NULL THEN p.warehouseId END AS warehouseId,
        CASE WHEN l.id IS NULL THEN p.locationId END AS locationId, CASE WHEN l.id IS NULL THEN p.minStock END AS minStock,
        CASE WHEN l.id IS NULL THEN p.maxStock END AS maxStock,
        CASE WHEN l.id IS NULL THEN p.unitPrice ELSE l.unitPrice END AS unitPrice,
        strftime(CASE WHEN l.id IS NULL THEN TIMESTAMP '1990-01-01' ELSE l.updatedAt END, '%Y-%m-%d %H:%M:%S') AS updatedAt
    FROM prod p {} JOIN latest l ON p.id = l.id"""


def guarded(table: str, *references: str) -> str:
    """``references``: one scalar sub-query per table that may hold the record ``x``."""
    counts = ", ".join(f"({r}) AS n{i}" for i, r in enumerate(references))
    names = ", ".join(f"n{i}" for i in range(len(references)))
    held = " OR ".join(f"n{i} > 0" for i in range(len(references)))
    return f"""SELECT id, concat_ws(',', {names}) AS held_by FROM (SELECT x.id, {counts} FROM {table} x) WHERE {held}"""


NEW_INVOICE = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id,
    concat('NEW-', l_orderkey, '-', l_linenumber) AS invoiceNumber, l_suppkey AS customerId,
    strftime(l_shipdate, '%Y-%m-%d') AS invoiceDate, CASE WHEN l_tax > 0.04 THEN 8.0 ELSE 0.0 END::DOUBLE AS taxRate"""

BODIES = {
    "overview": overview(),
    "overview_range": overview(f"WHERE {IN_YEAR}"),
    "inventory_by_warehouse": f"""SELECT *, totalInboundQuantity - totalOutboundQuantity AS netInventoryValue,
        onHandQuantity AS netInventoryQuantity FROM (
        SELECT w.id, w.name AS warehouseName, w.code AS warehouseCode, w.totalArea, w.usedArea,
            count(DISTINCT p.id) AS totalProducts, {IN_VAL} AS totalInventoryValue, {IN_QTY} AS totalInboundQuantity,
            {OUT_QTY} AS totalOutboundQuantity, {ON_HAND} AS onHandQuantity,
            {pct('w.usedArea', 'w.totalArea')} AS utilizationRate
        FROM wh w LEFT JOIN prod p ON w.id = p.warehouseId
        LEFT JOIN led t ON p.id = t.productId AND w.id = t.warehouseId
        GROUP BY w.id, w.name, w.code, w.totalArea, w.usedArea)""",
    "inventory_by_product": BY_PRODUCT,
    "inventory_by_product_filtered": f"SELECT * FROM ({BY_PRODUCT}) WHERE category = 'ECONOMY' AND stockStatus = 'low'",
    "transactions_timeline": timeline(),
    "transactions_timeline_range": timeline(f"WHERE {IN_YEAR} AND t.type = 'outbound'"),
    "transfer_report": transfers(),
    "transfer_report_range": transfers(f"AND {IN_YEAR} AND t.warehouseId = 3"),
    "adjustment_report": ADJUSTMENT,
    "adjustment_report_reason": ADJUSTMENT + " AND t.notes ILIKE '%r%'",
    "stocktake_report": f"SELECT {ENTRY} {ENTRY_FROM} WHERE t.reference LIKE 'ST-%'",
    "revenue_timeline": revenue("%Y-%m-%d"),
    "revenue_timeline_week": revenue("%Y-W%W"),
    "revenue_timeline_month": revenue("%Y-%m", f"AND {IN_YEAR}"),
    "top_products": top_products("totalRevenue", 10),
    "top_products_by_quantity": top_products("totalQuantity", 25),
    "top_products_by_transactions": top_products("transactionCount", 25),
    "warehouse_performance": performance("fan"),
    "warehouse_performance_exact": performance("single"),
    "warehouse_performance_range": performance("fan_week"),
    "trends": trends(30, VALUE_SUM),
    "trends_quantity": trends(365, QTY_SUM),
    "trends_transactions": trends(90, "CAST(count(*) AS DOUBLE)"),
    "low_stock_alert": LOW_STOCK + " ORDER BY onHand, id LIMIT 20",
    "low_stock_alert_all": LOW_STOCK,
    "storage_cost": storage_cost(),
    "storage_cost_range": storage_cost(
        "WHERE CAST(t.transactionDate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-07'"
    ),
    "warehouse_efficiency": efficiency("fan"),
    "warehouse_efficiency_exact": efficiency("single"),
    "ledger_list": LEDGER_LIST + " ORDER BY t.transactionDate DESC, t.id LIMIT 100",
    "ledger_list_all": LEDGER_LIST,
    "ledger_summary": f"""SELECT count(*) AS totalTransactions, count(CASE WHEN type = 'inbound' THEN 1 END) AS totalInbound,
        count(CASE WHEN type = 'outbound' THEN 1 END) AS totalOutbound,
        count(CASE WHEN type = 'transfer' THEN 1 END) AS totalTransfer,
        count(CASE WHEN type = 'adjustment' THEN 1 END) AS totalAdjustment, {SUMMARY_SUMS[0]} AS totalInQuantity,
        {SUMMARY_SUMS[1]} AS totalOutQuantity, {SUMMARY_SUMS[2]} AS totalInValue, {SUMMARY_SUMS[3]} AS totalOutValue
        FROM led t""",
    "ledger_daily": f"""SELECT {DAY} AS date, count(*) AS totalTransactions, {SUMMARY_SUMS[0]} AS inboundQuantity,
        {SUMMARY_SUMS[1]} AS outboundQuantity, {SUMMARY_SUMS[2]} AS inboundValue, {SUMMARY_SUMS[3]} AS outboundValue
        FROM led t WHERE t.transactionDate >= (SELECT CAST(max(transactionDate) AS DATE) FROM led) - 30 GROUP BY 1""",
    "on_hand": "SELECT productId, warehouseId, onHand FROM bykey",
    "product_list": PRODUCT_LIST,
    "product_search": PRODUCT_LIST + """ WHERE p.name ILIKE '%red%' OR p.sku ILIKE '%red%' OR p.description ILIKE '%red%'
        OR p.manufacturer ILIKE '%red%'""",
    "product_stock": f"""SELECT p.id, p.name, p.sku, w.id AS warehouseId, w.name AS warehouseName, l.id AS locationId,
        l.name AS locationName, {STOCK} FROM prod p LEFT JOIN wh w ON p.warehouseId = w.id
        LEFT JOIN loc l ON p.locationId = l.id LEFT JOIN led t ON p.id = t.productId AND w.id = t.warehouseId
        GROUP BY p.id, p.name, p.sku, w.id, w.name, l.id, l.name""",
    "warehouse_stock": f"""SELECT warehouseId, id, name, sku, category, minStock, maxStock, unitPrice, locationName,
        totalIn, totalOut, onHand, stockStatus FROM ({WAREHOUSE_PRODUCTS})""",
    "warehouse_products": WAREHOUSE_PRODUCTS,
    "warehouse_list": warehouse_list(f"CAST(sum({CATALOG_VALUE}) AS DOUBLE)"),
    "warehouse_list_exact": warehouse_list(CATALOG_VALUE_ONCE),
    "warehouse_stats": WAREHOUSE_STATS,
    "warehouse_locations": "SELECT * FROM valued",
    "warehouse_usage_report": f"""SELECT t.warehouseId, {DAY} AS date, t.type, count(*) AS transactionCount,
        {QTY_SUM} AS totalQuantity, {VALUE_SUM} AS totalValue, count(DISTINCT t.productId) AS uniqueProducts
        FROM led t GROUP BY ALL""",
    "location_list": """SELECT v.*, w.name AS warehouseName, w.code AS warehouseCode FROM valued v
        LEFT JOIN wh w ON v.warehouseId = w.id""",
    "location_list_by_type": """SELECT v.* EXCLUDE (inventoryValue), w.name AS warehouseName, w.code AS warehouseCode
        FROM valued v LEFT JOIN wh w ON v.warehouseId = w.id WHERE v.type = 'storage'""",
    "location_products": f"""SELECT {PRODUCT_COLUMNS}, u.name AS uomName, {STOCK} FROM prod p
        LEFT JOIN uom u ON p.uomId = u.id {HOME_JOIN} WHERE p.locationId IS NOT NULL GROUP BY {PRODUCT_COLUMNS}, u.name""",
    "warehouse_map": f"""SELECT *, {pct('productCount', 'capacity')} AS utilizationRate,
        capacity - productCount AS availableCapacity FROM valued""",
    "available_locations": """SELECT v.* EXCLUDE (inventoryValue), w.name AS warehouseName, w.code AS warehouseCode,
        capacity - productCount AS availableCapacity FROM valued v LEFT JOIN wh w ON v.warehouseId = w.id
        WHERE v.status = 'available' AND v.area >= 30 AND capacity - productCount > 0""",
    "location_stats_by_warehouse": location_stats("""count(DISTINCT p.id) AS totalProducts
        FROM wh w LEFT JOIN loc l ON w.id = l.warehouseId LEFT JOIN prod p ON l.id = p.locationId"""),
    "location_stats_by_warehouse_exact": location_stats("""(SELECT count(*) FROM prod p JOIN loc m ON p.locationId = m.id
        WHERE m.warehouseId = w.id) AS totalProducts FROM wh w LEFT JOIN loc l ON w.id = l.warehouseId"""),
    "customer_list": CUSTOMERS.format(""),
    "customer_search": CUSTOMERS.format("""WHERE c.name ILIKE '%build_ng%' OR c.code ILIKE '%build_ng%'
        OR c.contactPerson ILIKE '%build_ng%' OR c.phone ILIKE '%build_ng%'"""),
    "customer_transactions": f"""SELECT {LEDGER_COLUMNS}, t.customer, c.id AS customerId, p.name AS productName,
        p.sku AS productSku, w.name AS warehouseName FROM led t JOIN cust c ON t.customer = c.name
        LEFT JOIN prod p ON t.productId = p.id LEFT JOIN wh w ON t.warehouseId = w.id""",
    "invoice_list": INVOICES.format(""),
    "invoice_search": INVOICES.format("""WHERE i.invoiceNumber ILIKE '%inv-1%' OR c.name ILIKE '%inv-1%'
        OR c.code ILIKE '%inv-1%'"""),
    "invoice_document": """SELECT i.id, i.invoiceNumber, c.name AS customerName, c.code AS customerCode,
        CAST(0 AS INT) AS part, CAST(count(ii.invoiceId) AS INT) AS itemCount, coalesce(string_agg(concat_ws(':', ii.productId,
            ii.lineNo, CAST(ii.quantity AS BIGINT), CAST(ii.total AS DECIMAL(18,2)), p.sku), '|'
            ORDER BY ii.productId, ii.lineNo, ii.quantity, ii.unitPrice), '') AS items
        FROM inv i LEFT JOIN cust c ON i.customerId = c.id LEFT JOIN item ii ON i.id = ii.invoiceId
        LEFT JOIN prod p ON ii.productId = p.id GROUP BY i.id, i.invoiceNumber, c.name, c.code""",
    "invoice_summary": INVOICE_SUMMARY,
    "invoice_summary_range": INVOICE_SUMMARY + " WHERE invoiceDate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    "invoice_monthly": MONTHLY.format("(SELECT year(max(invoiceDate)) FROM inv)"),
    "invoice_monthly_year": MONTHLY.format("1996"),
    "invoice_totals": f"""SELECT invoiceId, subtotal, subtotal * 8 / 100 AS taxAmount,
        subtotal + subtotal * 8 / 100 AS total FROM (
        SELECT invoiceId, {dsum('total')} AS subtotal FROM item GROUP BY 1)""",
    "maintenance_plans": f"""SELECT {PLAN_COLUMNS}, m.status, w.name AS warehouseName, w.code AS warehouseCode,
        m.estimatedCost AS plannedCost, coalesce(m.estimatedCost, 0) AS totalPlannedCost
        FROM plan m LEFT JOIN wh w ON m.warehouseId = w.id""",
    "maintenance_progress": f"SELECT * REPLACE ({STAMP.format('updatedAt')} AS updatedAt) FROM prog",
    "incidents": f"""SELECT i.* REPLACE ({STAMP.format('reportedAt')} AS reportedAt), w.name AS warehouseName,
        w.code AS warehouseCode FROM inc i LEFT JOIN wh w ON i.warehouseId = w.id""",
    "staff_workload": """SELECT s.id, s.name, s.code, s.specialty, s.status, count(m.id) AS assignedPlans,
        count(i.id) AS assignedIncidents FROM staff s LEFT JOIN plan m ON s.name = m.responsibleStaff
        LEFT JOIN inc i ON s.name = i.resolvedBy GROUP BY s.id, s.name, s.code, s.specialty, s.status""",
    # Only A-Z are folded: "TH" finds "thống", and would not if it were "THỐNG".
    "staff_workload_exact": """SELECT s.id, s.name, s.code, s.specialty, s.status,
        (SELECT count(*) FROM plan m WHERE s.name = m.responsibleStaff) AS assignedPlans,
        (SELECT count(*) FROM inc i WHERE s.name = i.resolvedBy) AS assignedIncidents
        FROM staff s WHERE s.specialty LIKE '%th%'""",
    "maintenance_stats": plan_stats(),
    "maintenance_stats_range": plan_stats("WHERE plannedDate BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'"),
    "dashboard_kpis": f"""SELECT count(*) AS products, count(CASE WHEN onHand <= 5 THEN 1 END) AS lowStock,
        (SELECT count(*) FROM doc WHERE type = 'IN' AND CAST(createdAt AS DATE) = CAST({LAST_SLIP} AS DATE)) AS inToday,
        (SELECT count(*) FROM doc WHERE type = 'OUT' AND CAST(createdAt AS DATE) = CAST({LAST_SLIP} AS DATE)) AS outToday,
        (SELECT sum(totalArea - usedArea) FROM wh) AS freeArea, {dsum('unitPrice')} AS catalogValue FROM dstock""",
    "in_out_last_days": f"""SELECT strftime(d, '%Y-%m-%d') AS date,
        (SELECT count(*) FROM doc WHERE type = 'IN' AND CAST(createdAt AS DATE) = d) AS inCount,
        (SELECT count(*) FROM doc WHERE type = 'OUT' AND CAST(createdAt AS DATE) = d) AS outCount
        FROM (SELECT CAST({LAST_SLIP} AS DATE) - CAST(k AS INT) AS d FROM (SELECT unnest(range(7)) AS k))""",
    "top_on_hand": "SELECT id, sku AS code, onHand FROM dstock ORDER BY onHand DESC, id LIMIT 5",
    "top_moved_in": top_moved("IN"),
    "top_moved_out": top_moved("OUT"),
    "signed_value_trend": f"""SELECT strftime(d, '%Y-%m-%d') AS date, {dsum0('v')} AS value
        FROM (SELECT CAST({LAST_SLIP} AS DATE) - CAST(k AS INT) AS d FROM (SELECT unnest(range(30)) AS k)) days
        LEFT JOIN (SELECT CAST(x.createdAt AS DATE) AS day, x.signedQty * coalesce(p.unitPrice, 0) AS v
            FROM dline x LEFT JOIN prod p ON p.id = x.productId) ON day = d GROUP BY d""",
    "area_utilization": "SELECT sum(greatest(0, usedArea)) AS usedArea, sum(totalArea - usedArea) AS freeArea FROM wh",
    "free_area_by_warehouse": "SELECT id, code, totalArea - usedArea AS freeArea FROM wh",
    "low_stock_share": """SELECT count(CASE WHEN onHand <= 5 THEN 1 END) AS lowCount,
        count(CASE WHEN onHand > 5 THEN 1 END) AS okCount FROM dstock""",
    "revenue_by_warehouse": f"""SELECT w.id, w.code, floor({dsum0('v')} + 0.5) AS revenue FROM wh w
        LEFT JOIN (SELECT x.warehouseId, x.qty * coalesce(p.unitPrice, 0) AS v FROM dline x
            LEFT JOIN prod p ON p.id = x.productId WHERE x.type = 'OUT') s ON s.warehouseId = w.id GROUP BY w.id, w.code""",
    "revenue_by_group": f"""SELECT coalesce(substr(p.category, 1, 2), 'X') AS productGroup,
        {dsum('x.qty * coalesce(p.unitPrice, 0)')} AS revenue FROM dline x LEFT JOIN prod p ON p.id = x.productId
        WHERE x.type = 'OUT' GROUP BY 1""",
    "movement_report": movement(),
    "movement_report_range": movement("""WHERE warehouseId = 7 AND createdAt >= TIMESTAMP '1996-01-01'
        AND createdAt <= TIMESTAMP '1996-12-31'"""),
    "rent_quote": """SELECT l.warehouseId, w.rentalPrice AS unitPrice, l.area, CAST(m AS DOUBLE) AS months,
        w.rentalPrice * l.area * m AS total FROM (SELECT *, CASE WHEN id % 4 > 0 THEN 1 + id % 12 ELSE 1 END AS m FROM loc) l
        LEFT JOIN wh w ON w.id = l.warehouseId""",
    "reprice": """SELECT * REPLACE (CASE WHEN type = 'cold' THEN floor(rentalPrice * 1.075 + 0.5) ELSE rentalPrice END
        AS rentalPrice) FROM wh""",
    "stocktake_variance": """SELECT s.id AS productId, s.onHand AS systemQty,
        CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) ELSE s.onHand END AS countedQty,
        CASE WHEN p_size > 25 THEN p_size - s.onHand ELSE 0.0 END AS difference
        FROM dstock s JOIN part ON p_partkey = s.id""",
    "product_card": PRODUCT_CARD,
    "location_status_counts": """SELECT count(*) AS totalLocations,
        count(CASE WHEN status = 'available' THEN 1 END) AS availableLocations,
        count(CASE WHEN status = 'occupied' THEN 1 END) AS occupiedLocations,
        count(CASE WHEN status = 'full' THEN 1 END) AS fullLocations FROM loc""",
    "plan_status_counts": """SELECT count(*) AS totalMaintenance,
        count(CASE WHEN status = 'planned' THEN 1 END) AS pendingMaintenance,
        count(CASE WHEN status = 'in_progress' THEN 1 END) AS inProgressMaintenance,
        count(CASE WHEN status = 'completed' THEN 1 END) AS completedMaintenance FROM plan""",
    "entity_search": ENTITY_SEARCH,
    "entity_search_customers": f"{CUSTOMER_ROW} WHERE {has('machine', 'code', 'name', 'contactPerson')}",
    "advanced_search": f"""{CONTRACT_ROW} WHERE startDate >= '1996-06-01' AND endDate <= '2024-08-31'
        UNION ALL {INVOICE_ROW} WHERE issueDate >= '1996-06-01' AND dueDate <= '2024-08-31'""",
    "advanced_search_customer": f"""{CONTRACT_ROW} WHERE customerCode = 'C-7' AND contract.status = 'pending'
        UNION ALL {INVOICE_ROW} WHERE customerCode = 'C-7' AND invdoc.status = 'pending'""",
    "filtered_products": f"SELECT * FROM prod WHERE {has('blue', 'sku', 'name')}",
    "filtered_customers": f"""SELECT * FROM cust WHERE status = 'active' AND
        ({has('c12', 'code', 'name', 'contactPerson', 'email')} OR contains(phone, 'c12'))""",
    "filtered_invoices": f"""SELECT * FROM invdoc WHERE type = 'Nhập' AND status = 'paid' AND
        {has('urgent', 'code', 'customerName', 'description')}""",
    "validate_products": """SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_name ELSE '' END AS name,
        CASE WHEN p_size % 11 <> 0 THEN concat('SKU-', p_partkey) END AS sku,
        CASE WHEN p_size % 7 = 0 OR p_name = '' THEN 'name is missing' WHEN p_size % 11 = 0 THEN 'sku is missing' END
            AS reject_reason FROM part""",
    "validate_transactions": """SELECT id, CASE WHEN productId = 0 THEN 'productId is missing'
        WHEN warehouseId = 0 THEN 'warehouseId is missing' WHEN quantity <= 3 THEN 'quantity is missing'
        WHEN quantity > 40 THEN 'type is not allowed' ELSE '' END AS reject_reason FROM led""",
    "reject_duplicates": """SELECT id, CASE WHEN row_number() OVER (PARTITION BY sku ORDER BY id) = 1
        AND sku NOT IN (SELECT sku FROM prod) THEN 'accepted' ELSE 'rejected' END AS outcome
        FROM (SELECT p_partkey AS id, concat('SKU-', p_partkey % 5 + p_size * 1000) AS sku FROM part)""",
    "post_outbound": POSTED + " SELECT id, available, accepted FROM posted",
    "post_outbound_rejected": POSTED + """ SELECT id, available, quantity AS requested FROM posted WHERE NOT accepted AND warehouseId <> 0 AND productId <> 0
        UNION ALL SELECT id, NULL, quantity FROM led WHERE type IN ('outbound', 'transfer') AND (warehouseId = 0 OR productId = 0)""",
    "post_outbound_blanks": in_order(COMPLETE) + f""" SELECT id, p.quantity, {STAMP.format('b.transactionDate')} AS transactionDate,
        CASE WHEN p.accepted THEN '' ELSE 'not enough stock' END AS reject_reason FROM posted p JOIN {BLANKS} b USING (id)
        UNION ALL SELECT id, quantity, {STAMP.format('transactionDate')},
            CASE WHEN productId = 0 THEN 'productId is missing' WHEN warehouseId = 0 THEN 'warehouseId is missing' ELSE 'quantity is missing' END
        FROM {BLANKS} WHERE type IN ('outbound', 'transfer') AND (productId = 0 OR warehouseId = 0 OR coalesce(quantity, 0) = 0)""",
    "expand_transfers": TRANSFERRED,
    "expand_adjustments": f"""SELECT id, productId, warehouseId, locationId, notes, {T_DATE},
        CASE WHEN lack IS NOT NULL THEN 'rejected' WHEN notes = 'A' THEN 'inbound' ELSE 'outbound' END AS type,
        CASE WHEN lack IS NOT NULL AND notes <> 'A' THEN -quantity ELSE quantity END AS quantity,
        CASE WHEN lack IS NULL THEN 0.0::DOUBLE END AS unitPrice, coalesce(lack, concat('ADJUSTMENT: ', notes)) AS reference
        FROM (SELECT *, CASE WHEN productId = 0 THEN 'productId is missing' WHEN warehouseId = 0 THEN 'warehouseId is missing' END AS lack
            FROM led WHERE type = 'adjustment') t""",
    "upsert_latest": UPSERT.format("LEFT"),
    "upsert_latest_insert": UPSERT.format("FULL"),
    "upsert_latest_rejected": UPSERT_CHANGES + """ SELECT id, name, sku, unitPrice,
        CASE WHEN name = '' THEN 'name is missing' ELSE 'id is not known' END AS reject_reason
        FROM change WHERE name = '' OR id NOT IN (SELECT id FROM prod)""",
    "update_invoices": """SELECT i.id, coalesce(d.invoiceNumber, i.invoiceNumber) AS invoiceNumber,
        coalesce(d.customerId, i.customerId) AS customerId, strftime(coalesce(d.invoiceDate, i.invoiceDate), '%Y-%m-%d') AS invoiceDate,
        i.status, CASE WHEN d.id IS NULL THEN 5.0 ELSE d.taxRate END::DOUBLE AS taxRate, coalesce(d.subtotal, 0) AS subtotal,
        coalesce(d.subtotal * d.taxRate / 100, 0) AS taxAmount,
        CASE WHEN d.id IS NULL THEN i.total ELSE d.subtotal + d.subtotal * d.taxRate / 100 END AS total
        FROM inv i LEFT JOIN (SELECT * FROM udoc WHERE reason IS NULL) d ON d.id = i.id""",
    "update_invoices_items": """SELECT invoiceId, productId, lineNo, quantity, unitPrice, total FROM item
        WHERE invoiceId NOT IN (SELECT id FROM udoc WHERE reason IS NULL)
        UNION ALL SELECT id, o_custkey, NULL, 2.0, o_totalprice, 2.0 * o_totalprice FROM udoc WHERE reason IS NULL
        UNION ALL SELECT id, o_custkey + 1, NULL, 3.0, 10.25, 30.75 FROM udoc WHERE reason IS NULL""",
    "update_invoices_rejected": "SELECT id, invoiceNumber, reason AS reject_reason FROM udoc WHERE reason IS NOT NULL",
    "upsert_area_usage": f"""SELECT w.id, w.name, w.code, w.totalArea, w.rentalPrice, w.type,
        coalesce(t.quantity, w.usedArea) AS usedArea,
        coalesce({STAMP.format('t.transactionDate')}, '1990-01-01 00:00:00') AS updatedAt
        FROM wh w LEFT JOIN (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY warehouseId
            ORDER BY transactionDate DESC, quantity DESC) = 1) t ON t.warehouseId = w.id""",
    "post_invoices": f"""SELECT id, invoiceNumber, customerId, invoiceDate, taxRate, subtotal,
        subtotal * taxRate / 100 AS taxAmount, subtotal + subtotal * taxRate / 100 AS total FROM (
        SELECT {NEW_INVOICE}, CAST(CAST(l_quantity * 10.25 AS DECIMAL(18,2)) + CAST(2 * l_extendedprice AS DECIMAL(18,2))
            AS DOUBLE) AS subtotal FROM lineitem WHERE l_suppkey <> 0)""",
    "post_invoices_items": f"""SELECT id AS invoiceId, productId, quantity, unitPrice, quantity * unitPrice AS total FROM (
        SELECT {NEW_INVOICE}, l_partkey AS productId, l_quantity AS quantity, 10.25::DOUBLE AS unitPrice
        FROM lineitem WHERE l_suppkey <> 0
        UNION ALL SELECT {NEW_INVOICE}, l_partkey + 1, 2.0, l_extendedprice FROM lineitem WHERE l_suppkey <> 0)""",
    "plain_delete_rejected": "SELECT DISTINCT concat(id, '-x') AS id, 'id is not known' AS reject_reason FROM led WHERE type = 'transfer'",
    "plain_delete": f"SELECT {LEDGER_COLUMNS} FROM led t WHERE t.type <> 'adjustment'",
    "replace_children_invoices": f"""SELECT i.id, i.invoiceNumber, i.customerId,
        strftime(i.invoiceDate, '%Y-%m-%d') AS invoiceDate, i.status, 8.0::DOUBLE AS taxRate,
        coalesce(s.subtotal, 0) AS subtotal, coalesce(s.subtotal * 8 / 100, 0) AS taxAmount,
        CASE WHEN s.subtotal IS NULL THEN i.total ELSE s.subtotal + s.subtotal * 8 / 100 END AS total
        FROM inv i LEFT JOIN (SELECT invoiceId, {dsum('total')} AS subtotal FROM item WHERE lineNo <= 2 GROUP BY 1) s
        ON s.invoiceId = i.id""",
    "replace_children_items": """SELECT invoiceId, productId, lineNo, quantity, unitPrice,
        CASE WHEN lineNo <= 2 THEN quantity * unitPrice ELSE total END AS total FROM item x WHERE (lineNo <= 2 AND EXISTS (SELECT 1 FROM inv WHERE inv.id = x.invoiceId))
        OR NOT EXISTS (SELECT 1 FROM item y JOIN inv ON inv.id = y.invoiceId
            WHERE y.invoiceId = x.invoiceId AND y.lineNo <= 2)""",
    "guarded_delete_products": guarded("prod", "SELECT count(*) FROM led WHERE productId = x.id"),
    "guarded_delete_warehouses": guarded(
        "wh", "SELECT count(*) FROM prod WHERE warehouseId = x.id", "SELECT count(*) FROM led WHERE warehouseId = x.id"
    ),
    "guarded_delete_locations": guarded("loc", "SELECT count(*) FROM prod WHERE locationId = x.id"),
    "guarded_delete_customers": guarded("cust", "SELECT count(*) FROM inv WHERE customerId = x.id"),
    "cascade_delete_invoices": """SELECT * REPLACE (strftime(invoiceDate, '%Y-%m-%d') AS invoiceDate) FROM inv
        WHERE status <> 'overdue'""",
    "cascade_delete_items": """SELECT * FROM item
        WHERE invoiceId NOT IN (SELECT id FROM inv WHERE status = 'overdue')""",
    "latest_plan_status": f"""SELECT {PLAN_COLUMNS}, coalesce((SELECT g.status FROM prog g WHERE g.planId = m.id
        ORDER BY g.updatedAt DESC, g.id DESC LIMIT 1), m.status) AS status FROM plan m""",
    "documents_to_ledger": f"""SELECT concat(d.id, '-', row_number() OVER (PARTITION BY d.id ORDER BY l_partkey, l_quantity) - 1)
        AS id, CASE WHEN d.type = 'IN' THEN 'inbound' ELSE 'outbound' END AS type, l_partkey AS productId, d.warehouseId,
        l_quantity AS quantity, d.code AS reference, {STAMP.format('d.createdAt')} AS transactionDate, p.unitPrice
        FROM doc d JOIN lineitem ON l_orderkey = d.id LEFT JOIN prod p ON p.id = l_partkey""",
    "resolve_products": """SELECT p_partkey AS id, u.id AS uomId, w.id AS warehouseId,
        (SELECT min(l.id) FROM loc l WHERE l.code = concat('L', p_partkey % 5)) AS locationId
        FROM part JOIN uom u ON u.code = concat('U', p_partkey % 7) JOIN wh w ON w.code = concat('W', p_partkey % 25)
        WHERE p_partkey % 5 < 4""",
    "resolve_products_exact": """SELECT p_partkey AS id, u.id AS uomId, w.id AS warehouseId, l.id AS locationId
        FROM part JOIN uom u ON u.code = concat('U', p_partkey % 7) JOIN wh w ON w.code = concat('W', p_partkey % 25)
        JOIN loc l ON l.code = concat('L', p_partkey % 5) AND l.warehouseId = w.id""",
    # The inch sign of the name is doubled, then comes the closing quote.
    "csv_export": "SELECT concat('\"SKU-', p_partkey, '\",\"', p_name, ' 24\"\"\",\"', p_brand, '\"') AS line FROM part",
    "json_rows": """SELECT concat('{"id":', id, ',"code":"', code, '","name":"', name, '","status":"', status, '"}') AS json
        FROM cust""",
    "csv_sink": "SELECT concat('SKU-', p_partkey) AS code, concat(p_name, ' 24\"') AS name, p_brand AS brand FROM part",
    "json_sink": "SELECT id, code, name, status FROM cust",
}
BODIES["ledger_by_month"] = BODIES["ledger_summary"] + " WHERE transactionDate >= '1996-01-01' AND transactionDate < '1997-01-01'"

BODIES |= {
    "on_hand_changes": BODIES["on_hand"],
    "stored_upsert": BODIES["upsert_latest"],
    "stored_upsert_rejected": BODIES["upsert_latest_rejected"],
    "stored_replace_invoices": BODIES["replace_children_invoices"],
    "stored_replace_items": BODIES["replace_children_items"],
    "stored_cascade_invoices": BODIES["cascade_delete_invoices"],
    "stored_cascade_items": BODIES["cascade_delete_items"],
    "stored_guarded_delete": BODIES["guarded_delete_products"],
    "stored_ledger_changes": f"""WITH early AS (SELECT id, quantity FROM led WHERE transactionDate < '1993-01-01'),
        corrected AS (SELECT DISTINCT id FROM early WHERE quantity = 11)
        SELECT t.id, t.type, t.productId, t.warehouseId, CASE WHEN c.id IS NULL THEN t.quantity ELSE 1.5 END AS quantity,
        CASE WHEN c.id IS NULL THEN t.unitPrice ELSE 2.5 END AS unitPrice,
        CASE WHEN c.id IS NULL THEN {STAMP.format("t.transactionDate")} ELSE '1993-06-15 10:00:00' END AS transactionDate
        FROM led t LEFT JOIN corrected c ON c.id = t.id WHERE t.id NOT IN (SELECT id FROM early WHERE quantity = 13)""",
    "ledger_list_skewed": "WITH hot AS (SELECT * REPLACE (CASE WHEN quantity < 45 THEN 7 ELSE productId END AS productId) FROM led) "
    + LEDGER_LIST.replace("FROM led t", "FROM hot t"),
    "on_hand_snapshot": BODIES["on_hand"],
    "inventory_by_product_snapshot": BODIES["inventory_by_product"],
    "inventory_by_warehouse_snapshot": BODIES["inventory_by_warehouse"],
    "low_stock_alert_snapshot": BODIES["low_stock_alert_all"],
    "repeated_append": BODIES["ledger_summary"],
    "broken_documents": """SELECT CAST(CASE WHEN o_orderkey % 10 > 2 THEN o_orderkey END AS VARCHAR) AS id,
        CAST(CASE WHEN o_orderkey % 10 > 2 THEN o_custkey END AS VARCHAR) AS warehouseId,
        CAST(CASE WHEN o_orderkey % 10 > 2 THEN o_orderkey % 7 END AS DOUBLE) AS qty,
        CASE o_orderkey % 10 WHEN 0 THEN left(concat('{"id":"', o_orderkey, '","type":"IN","warehouseId":"', o_custkey), 30)
            WHEN 1 THEN concat('{"id":"', o_orderkey, '","type":"IN","warehouseId":"', o_custkey,
                '","lines":[{"productId":"p","qty":"many"}]}')
            WHEN 2 THEN concat('no document ', o_orderkey) ELSE '' END AS line FROM orders""",
    "ledger_by_id": LEDGER_LIST + " WHERE t.id = (SELECT max(id) FROM led)",
    "invoice_by_id": BODIES["invoice_document"].replace("GROUP BY i.id", "WHERE i.id = (SELECT max(id) FROM inv) GROUP BY i.id"),
    "product_by_id": PRODUCT_LIST + " WHERE p.id = (SELECT max(id) FROM prod)",
    "stored_tables": PRODUCT_LIST,
    "product_search_indexed": BODIES["product_search"],
    "customer_search_indexed": BODIES["customer_search"],
    "distinct_products_daily": f"SELECT {DAY} AS date, CAST(count(DISTINCT t.productId) AS BIGINT) AS uniqueProducts FROM led t GROUP BY 1",
    "distinct_products_monthly": """SELECT strftime(t.transactionDate, '%Y-%m') AS month,
        CAST(count(DISTINCT t.productId) AS BIGINT) AS uniqueProducts FROM led t GROUP BY 1""",
}


def with_ctes(body: str) -> str:
    """Put the views a query needs, and those they need, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"(?<![.\w']){name}(?![\w'])", text):
                needed.add(name)
                visit(definition)

    visit(body)
    views = ", ".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    if not views:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body.removeprefix('WITH RECURSIVE ')}"
    if body.startswith("WITH "):
        return f"WITH {views}, {body.removeprefix('WITH ')}"
    return f"WITH {views} {body}"


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in BODIES.items()}
