"""Stock as stored partial sums by month, so that reports need not read the whole ledger.

The state holds, for each month, product and warehouse, the sums of ``numbers.parts_of`` over the
ledger lines of that month. Such sums merge by adding, whatever their order, and what was
removed is taken off again: state and changes together give the very figures of the
ledger. A month whose lines changed, by late, corrected or deleted ones, is summed anew from its own lines; no other
month is read or written.

Reports read the state instead of the ledger if the tables hold it as ``stock_snapshot``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.numbers import PARTS, PARTS_TYPE, parts_of
from depotlens.plans.stock import AMOUNTS, movements

KEY = ("productId", "warehouseId")
NO_MONTH = "none"
SCHEMA = ", ".join(
    ["productId bigint, warehouseId bigint, rows bigint", *[f"{name} {PARTS_TYPE}" for name in AMOUNTS], "month string"]
)


def month_of(date: str = "transactionDate") -> Column:
    """Month of a ledger line; lines without a date have one of their own."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


def partial_sums(ledger: DataFrame) -> DataFrame:
    """The state of these ledger lines."""
    measures = [
        F.struct(*[F.sum(value).alias(part) for part, value in parts_of(amount()).items()]).alias(name)
        for name, amount in AMOUNTS.items()
    ]
    lines = ledger if "month" in ledger.columns else ledger.withColumn("month", month_of())
    keys = [F.col(k).cast("bigint").alias(k) for k in KEY]
    summed = lines.groupBy(*keys, "month").agg(F.count("*").alias("rows"), *measures)
    return summed.select(*KEY, "rows", *AMOUNTS, "month")


def _write(state: DataFrame, path: str, mode: str) -> None:
    # Ranges over month and key: few files for each month, and a large month in several.
    dealt = state.repartitionByRange("month", *KEY)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").parquet(path)


def build(ledger: DataFrame, path: str) -> None:
    """Write the state of a whole ledger."""
    _write(partial_sums(ledger), path, "static")


def read(spark: SparkSession, path: str) -> DataFrame:
    # A month without lines keeps a row without a key, which marks that it is up to date.
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("rows") > 0)


def changed_months(*changes: DataFrame) -> list[str]:
    """Months of added, removed, and both versions of corrected lines; as many as the calendar has, not as there are lines."""
    months = reduce(DataFrame.union, [c.select(month_of().alias("month")) for c in changes]).distinct()
    return sorted(row["month"] for row in months.collect())


def refresh(ledger: DataFrame, path: str, months: Sequence[str]) -> None:
    """Sum the given months anew. A ledger that is stored by ``month`` is read in these months only."""
    if not months:
        return
    stored = "month" in ledger.columns
    lines = ledger.filter((F.col("month") if stored else month_of()).isin(*months))
    spark = ledger.sparkSession
    blank = spark.createDataFrame([(m,) for m in months], "month string").select(
        *[F.lit(None).cast("bigint").alias(k) for k in KEY], F.lit(0).cast("bigint").alias("rows"),
        *[F.lit(None).cast(PARTS_TYPE).alias(name) for name in AMOUNTS], "month",
    )
    _write(partial_sums(lines).unionByName(blank), path, "dynamic")


def removed(state: DataFrame) -> DataFrame:
    """The state that takes these lines off again."""
    taken = [
        F.struct(*[(-F.col(f"{name}.{part}")).alias(part) for part in PARTS]).alias(name) for name in AMOUNTS
    ]
    return state.select(*KEY, (-F.col("rows")).alias("rows"), *taken, "month")


def with_changes(state: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The state with ledger lines that came or went after it was written; corrected lines are in both."""
    if added is not None:
        state = state.unionByName(partial_sums(added))
    return state if deleted is None else state.unionByName(removed(partial_sums(deleted)))


def totals(state: DataFrame, columns: Sequence[str] = tuple(AMOUNTS)) -> DataFrame:
    """Movement columns per product and warehouse that still have lines."""
    found = movements(state, KEY, [*columns, "rows"])
    return found.filter(F.col("rows") > 0).drop("rows")
