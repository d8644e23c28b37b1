"""Posting stock requests in order against the stock they find.

An outbound or transfer request is accepted when the stock at its turn covers it; rejected
requests change nothing. Each decision depends on all earlier ones of the same product and
warehouse (of all its warehouses, for transfers, which feed one another), so a running sum cannot make it. Requests are
folded in order, key by key, one batch in memory.

A key of more than ``HOT`` requests is cut into chunks by ranges of its order. A chunk knows by running sums the stock from
which on all its requests are accepted, and the stock below which all are rejected. One walk over these bounds, which never sees a
request, tells most chunks to be the one or the other; only requests of the others are folded one after the other, between
them the settled chunks count as one step each. Then every chunk's start is known, and all chunks are folded side by side.
That is a fixed number of passes, whatever hangs on what.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.columns import is_blank
from depotlens.operators.batch import validate_batch
from depotlens.plans.durable import materialize
from depotlens.plans.lookups import only_keys_of
from depotlens.plans.stock import movements

CHECKED_TYPES = ("outbound", "transfer")
KEY = ["productId", "warehouseId"]
#: Stock is compared to nine places, as sums of reports are; one digit less than the most, so that adding loses none.
PLACES = 9
EXACT = T.DecimalType(37, PLACES)
#: Requests of a key that one task folds; more are cut into chunks.
HOT = 1_000_000
#: Rows of the folded stream, in this order within a chunk.
START, STEP, REQUEST = 0, 1, 2


def _zero() -> Column:
    return F.lit(0).cast(EXACT)


def _units(column: str) -> Column:
    return F.coalesce(F.col(column).cast(EXACT), _zero())


def _integers(values: pa.Array) -> list[int]:
    """Decimals as whole numbers of their last place."""
    words = np.frombuffer(values.buffers()[1], np.int64).reshape(-1, 2)[values.offset : values.offset + len(values)]
    low, high = words[:, 0], words[:, 1]
    if not np.any(high ^ (low >> 63)):
        return low.tolist()
    return [(h << 64) | (x & (1 << 64) - 1) for x, h in zip(low.tolist(), high.tolist())]


def _decimals(values: list[int]) -> pa.Array:
    exact = Context(prec=60)
    return pa.array([Decimal(v).scaleb(-PLACES, exact) for v in values], pa.decimal128(37, PLACES))


def _stream(keys: Sequence[str]):
    """Rows of a sorted stream with the stock they find: (group, row, account, target, checked, units, delta, kind, balances)."""

    def walk(batch: pa.RecordBatch, state: list) -> Iterator[tuple[int, int, int, bool]]:
        columns = [batch.column(c).to_pylist() for c in (*keys, "_kind", "_account", "_target", "checked")]
        units, deltas = _integers(batch.column("units")), _integers(batch.column("delta"))
        group, balances = state
        n = len(keys)
        for at, values in enumerate(zip(*columns, units, deltas)):
            own = values[:n]
            if own != group:
                group, balances = own, {}
            kind, account, target, checked, needed, delta = values[n:]
            have = balances.get(account, 0)
            accepted = kind != REQUEST or not checked or have >= needed
            yield at, kind, have, accepted
            if accepted:
                balances[account] = have + delta
                if target is not None:
                    balances[target] = balances.get(target, 0) + needed
        state[:] = group, balances

    return walk


EVENT = ("_kind", "_account", "_target", "checked", "units", "delta")


def _folded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The requests of a stream of starts and requests, with ``available`` and ``accepted``."""
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "_kind", "_place").drop("_place")
    schema = T.StructType([*rows.schema["request"].dataType.fields, T.StructField("available", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, state = _stream(keys), [None, {}]
        for batch in batches:
            found = [(at, have, accepted) for at, kind, have, accepted in walk(batch, state) if kind == REQUEST]
            at, have, accepted = zip(*found) if found else ((), (), ())
            requests = batch.column("request").take(pa.array(at, pa.int64()))
            verdicts = [pa.array([x / 10**PLACES for x in have], pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*requests.flatten(), *verdicts], schema.names)

    return placed.mapInArrow(fold, schema)


def _start_rows(stock: DataFrame, keys: Sequence[str], request: T.DataType, place: T.DataType) -> DataFrame:
    """Rows that set the stock of an account (``stock``) before the first request of a key."""
    return stock.select(
        *keys, F.lit(START).alias("_kind"), F.lit(None).cast(place).alias("_place"), F.col("_account"), F.lit(None).cast("bigint").alias("_target"),
        F.lit(False).alias("checked"), _zero().alias("units"), F.col("stock").alias("delta"), F.lit(None).cast(request).alias("request"),
    )


def opening_stock(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Stock before the batch per key; only of the wanted keys if they are few."""
    wanted = only_keys_of(ledger, keys.select(*KEY).distinct(), KEY)
    return movements(wanted, KEY, ("onHand",)).select(*KEY, F.col("onHand").cast(EXACT).alias("stock"))


def _bounds(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each chunk and account: what it moves if all or none of the checked requests are accepted, and the
    stock from which on all, or below which none is.

    The others bound its end where neither holds. ``least`` and ``most`` are what it can move at all. If a request is rejected, the stock
    is below what it needs, and at the end below ``cap``; if none is, all of ``spent`` went. If one is accepted, the stock is not
    below zero, and at the end not below ``floor``.
    """
    legs = events.select(
        *keys, "_part", "_place", "checked",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("leg"), F.col("_account"), F.col("delta").alias("amount"), F.col("units").alias("needed")),
                F.struct(F.lit(1).alias("leg"), F.col("_target").alias("_account"), F.col("units").alias("amount"), F.lit(None).cast(EXACT).alias("needed")),
            )
        ).alias("side"),
    ).select(*keys, "_part", "_place", "checked", "side.*").filter("_account IS NOT NULL")
    before = Window.partitionBy(*keys, "_part", "_account").orderBy("_place", "leg").rowsBetween(Window.unboundedPreceding, -1)
    sure, amount = ~F.col("checked"), F.col("amount")

    def running(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before).cast(EXACT), _zero())

    judged = F.col("checked") & F.col("needed").isNotNull()
    gained = F.when(sure | (amount > 0), amount)
    placed = legs.withColumns(
        {
            "_all": F.when(judged, F.col("needed") - running(amount)),
            "_none": F.when(judged, F.col("needed") - running(F.when(sure, amount))),
            "_cap": F.when(judged, F.col("needed") - running(gained) - F.greatest(amount, _zero())),
            "_floor": F.when(judged, -running(F.when(sure, amount))),
        }
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value).cast(EXACT), _zero())

    most, none = total(gained), total(F.when(sure, amount))
    return placed.groupBy(*keys, "_part", "_account").agg(
        total(amount).alias("all"), none.alias("none"),
        F.max("_all").cast(EXACT).alias("accept_from"), F.min("_none").cast(EXACT).alias("reject_below"),
        total(F.when(sure | (amount < 0), amount)).alias("least"), most.alias("most"),
        total(F.when(judged, F.least(amount, _zero()))).alias("spent"),
        (F.max("_cap") + most).cast(EXACT).alias("cap"), (F.min("_floor") + none).cast(EXACT).alias("floor"),
    )


def _judge(table: pa.Table) -> pa.Table:
    """Which chunks of a key are settled: the bounds of the stock at each chunk's start against its own."""
    table = table.sort_by("_part")
    parts, accounts = table.column("_part").to_pylist(), table.column("_account").to_pylist()
    values = {c: table.column(c).to_pylist() for c in ("all", "none", "accept_from", "reject_below", "least", "most", "spent", "cap", "floor")}
    # ``high`` comes with 1 if the stock may be that much, 0 if it is below.
    low: dict[int, Decimal] = {}
    high: dict[int, tuple[Decimal, int]] = {}
    zero, add = Decimal(0), Context(prec=60).add
    verdicts, at = [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and parts[end] == parts[at]:
            end += 1
        rows = range(at, end)
        own = [i for i in rows if values["accept_from"][i] is not None]
        if all(low.get(accounts[i], zero) >= values["accept_from"][i] for i in own):
            verdict = "all"
        elif all(high.get(accounts[i], (zero, 1)) < (values["reject_below"][i], 1) for i in own):
            verdict = "none"
        else:
            verdict = "open"
        for i in rows:
            (down, (up, within)), account = (low.get(accounts[i], zero), high.get(accounts[i], (zero, 1))), accounts[i]
            if verdict != "open":
                low[account], high[account] = add(down, values[verdict][i]), (add(up, values[verdict][i]), within)
                continue
            low[account], high[account] = add(down, values["least"][i]), (add(up, values["most"][i]), within)
            if i in own:
                low[account] = max(low[account], min(add(down, values["none"][i]), values["floor"][i]))
                spent = add(high[account][0], values["spent"][i]), within
                high[account] = min(high[account], max(spent, (values["cap"][i], 0)))
        verdicts += [verdict] * len(rows)
        at = end
    return table.append_column("verdict", pa.array(verdicts, pa.string()))


def _chunk_starts(events: DataFrame, stock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_part``, ``_account``, ``stock``) at the start of every chunk."""
    bounds = _bounds(events, keys)
    opening = stock.select(
        *keys, F.lit(-1).alias("_part"), "_account", F.col("stock").alias("all"), F.col("stock").alias("none"),
        *[F.col("stock").alias(c) for c in ("least", "most")], *[F.lit(None).cast(EXACT).alias(c) for c in ("accept_from", "reject_below", "spent", "cap", "floor")],
    )
    both = bounds.unionByName(opening)
    schema = T.StructType([*both.schema.fields, T.StructField("verdict", T.StringType())])
    # A key has a row for each chunk and account here, however many requests there are.
    judged = materialize(both.groupBy(*keys).applyInArrow(_judge, schema), "posting-bounds")
    shift = F.when(F.col("verdict") == "all", F.col("all")).when(F.col("verdict") == "none", F.col("none")).otherwise(_zero())
    steps = judged.select(
        *keys, "_part", F.lit(STEP).alias("_kind"), F.lit(None).cast(events.schema["_place"].dataType).alias("_place"), "_account",
        F.lit(None).cast("bigint").alias("_target"), F.lit(False).alias("checked"), _zero().alias("units"), shift.alias("delta"),
    )
    unsettled = judged.filter("verdict = 'open'").select(*keys, "_part").distinct()
    doubtful = events.drop("request").join(unsettled, [*keys, "_part"], "left_semi")
    rows = steps.unionByName(doubtful.select(*steps.columns))
    # In order, a key in one task: the requests of open chunks only.
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "_part", "_kind", "_place").drop("_place")
    told = T.StructType([*[events.schema[k] for k in keys], T.StructField("_part", T.IntegerType()), events.schema["_account"], T.StructField("stock", EXACT)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, state = _stream(keys), [None, {}]
        for batch in batches:
            found = [(at, have) for at, kind, have, _ in walk(batch, state) if kind == STEP]
            rows = batch.take(pa.array([at for at, _ in found], pa.int64())).select([*keys, "_part", "_account"])
            yield pa.RecordBatch.from_arrays([*rows.columns, _decimals([have for _, have in found])], told.names)

    return materialize(placed.mapInArrow(follow, told).filter("_part >= 0"), "posting-starts")


def _decided(events: DataFrame, stock: DataFrame, keys: Sequence[str], partitions: int | None, hot: int) -> DataFrame:
    """``events`` are requests with their keys, ``_place`` and the columns of ``EVENT``; ``stock`` has the keys, ``_account`` and ``stock``."""
    request, place = events.schema["request"].dataType, events.schema["_place"].dataType
    starts = _start_rows(stock, keys, request, place)
    if partitions is None:
        crowded = events.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot).select(*keys)
        if crowded.isEmpty():
            return _folded(starts.unionByName(events), keys)
        crowded = materialize(crowded, "posting-hot-keys")
        usual = _folded(starts.join(crowded, keys, "left_anti").unionByName(events.join(crowded, keys, "left_anti")), keys)
        events, stock = events.join(crowded, keys, "left_semi"), stock.join(crowded, keys, "left_semi")
    # Ranges over key and order cut a key into chunks, in order.
    ranged = events.repartitionByRange(*[partitions] if partitions else [], *keys, "_place")
    chunks = materialize(ranged.withColumn("_part", F.spark_partition_id()), "posting-events")
    grouped = [*keys, "_part"]
    begun = _start_rows(_chunk_starts(chunks, stock, keys), grouped, request, place)
    split = _folded(begun.unionByName(chunks.select(*begun.columns)), grouped)
    return split if partitions else usual.unionByName(split)


def decide(
    requests: DataFrame,
    ledger: DataFrame,
    order_by: Sequence[str] = ("transactionDate", "id"),
    partitions: int | None = None,
    hot: int = HOT,
) -> DataFrame:
    """Requests with ``available`` (stock at their turn) and ``accepted``.

    ``order_by`` must order the requests of a key without ties, and no request may lack its
    product or warehouse (``post_outbound`` rejects those). Types other than outbound and transfer are always
    accepted and move the stock. ``ledger`` may also be the partial sums of ``plans.snapshot``. Keys of more than ``hot`` requests are
    cut into chunks; with ``partitions`` all are, in so many ranges.
    """
    units = _units("quantity")
    events = requests.select(
        *KEY, F.lit(REQUEST).alias("_kind"), F.struct(*order_by).alias("_place"), F.col("warehouseId").cast("bigint").alias("_account"),
        F.lit(None).cast("bigint").alias("_target"), F.coalesce(F.col("type").isin(*CHECKED_TYPES), F.lit(False)).alias("checked"),
        units.alias("units"), F.when(F.col("type") == "inbound", units).otherwise(-units).cast(EXACT).alias("delta"),
        F.struct(*requests.columns).alias("request"),
    )
    stock = opening_stock(ledger, requests).withColumn("_account", F.col("warehouseId").cast("bigint"))
    return _decided(events, stock, KEY, partitions, hot)


def _dated(requests: DataFrame, name: str, now: datetime | None) -> DataFrame:
    """Blank dates are ``now``."""
    kind = requests.schema[name].dataType if name in requests.columns else T.TimestampType()
    given = F.col(name) if name in requests.columns else F.lit(None)
    return requests.withColumn(name, F.when(is_blank(requests, name), F.lit(now or datetime.now()).cast(kind)).otherwise(given))


def _all_rejected(invalid: DataFrame, short: DataFrame) -> DataFrame:
    """Requests that lack something, and those the stock does not cover."""
    short = short.drop("accepted").withColumn("reject_reason", F.lit("not enough stock"))
    return short.unionByName(invalid, allowMissingColumns=True).withColumn("requested", F.col("quantity"))


def post_outbound(
    requests: DataFrame,
    ledger: DataFrame,
    order_by: Sequence[str] = ("transactionDate", "id"),
    partitions: int | None = None,
    now: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows to append, rejected requests with ``reject_reason``, ``available`` and ``requested``).

    Requests without type, product, warehouse or quantity (0 counts as none) are rejected before anything
    is decided, without ``available``. A blank date is ``now``.
    """
    valid, invalid = validate_batch(_dated(requests, "transactionDate", now), "transactions")
    decided = decide(valid, ledger, order_by, partitions)
    return decided.filter("accepted").select(*valid.columns), _all_rejected(invalid, decided.filter("NOT accepted"))


LEG = ["id", "type", "productId", "warehouseId", "locationId", "quantity", "unitPrice", "reference", "notes", "transactionDate"]


def transfer_legs(requests: DataFrame) -> DataFrame:
    """Two ledger rows per transfer request: outbound at the source, inbound at the target.

    ``id`` is the request's id with ``-out`` or ``-in``, ``request`` the id itself.
    """

    def leg(number: int, kind: str, suffix: str, side: str) -> Column:
        return F.struct(
            F.concat_ws("-", "id", F.lit(suffix)).alias("id"),
            F.lit(number).alias("leg"),
            F.lit(kind).alias("type"),
            F.col(f"{side}WarehouseId").alias("warehouseId"),
            F.col(f"{side}LocationId").alias("locationId"),
        )

    both = F.explode(F.array(leg(0, "outbound", "out", "from"), leg(1, "inbound", "in", "to"))).alias("side")
    common = ("productId", "quantity", "unitPrice", "reference", "notes")
    rows = requests.select(F.col("id").alias("request"), *common, F.col("transferDate").alias("transactionDate"), both)
    return rows.select("request", *common, "transactionDate", "side.*")


def expand_transfers(
    requests: DataFrame, ledger: DataFrame, partitions: int | None = None, now: datetime | None = None, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """(both legs of every covered transfer, rejected requests as of ``post_outbound``).

    A transfer also feeds later ones out of its target, so all transfers of a product are decided in one
    order, by time and id, over the stock of all its warehouses: a chain of transfers of any length takes no
    further pass. A blank date is ``now``.
    """
    valid, invalid = validate_batch(_dated(requests, "transferDate", now), "transfers")
    units = _units("quantity")
    events = valid.select(
        "productId", F.lit(REQUEST).alias("_kind"), F.struct("transferDate", "id").alias("_place"), F.col("fromWarehouseId").cast("bigint").alias("_account"),
        F.col("toWarehouseId").cast("bigint").alias("_target"), F.lit(True).alias("checked"), units.alias("units"), (-units).cast(EXACT).alias("delta"),
        F.struct(*valid.columns).alias("request"),
    )
    sides = F.explode(F.array("fromWarehouseId", "toWarehouseId")).alias("warehouseId")
    stock = opening_stock(ledger, valid.select("productId", sides)).select("productId", F.col("warehouseId").cast("bigint").alias("_account"), "stock")
    decided = materialize(_decided(events, stock, ["productId"], partitions, hot), "transfer-verdicts")
    posted = transfer_legs(decided.filter("accepted")).select(*LEG)
    return posted, _all_rejected(invalid, decided.filter("NOT accepted"))


def expand_adjustments(requests: DataFrame, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger rows of signed adjustments, rejected requests with ``reject_reason``).

    Rows are inbound or outbound, without price or stock check; a blank date is ``now``.
    """
    valid, invalid = validate_batch(_dated(requests, "adjustmentDate", now), "adjustments")
    posted = valid.select(
        "id",
        F.when(F.col("quantity") > 0, "inbound").otherwise("outbound").alias("type"),
        "productId",
        "warehouseId",
        "locationId",
        F.abs("quantity").alias("quantity"),
        F.lit(0.0).alias("unitPrice"),
        F.concat(F.lit("ADJUSTMENT: "), F.col("reason")).alias("reference"),
        "notes",
        F.col("adjustmentDate").alias("transactionDate"),
    )
    return posted, invalid
