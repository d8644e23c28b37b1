"""Left joins that add attributes of a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's size estimate of the frame is within the session's broadcast limit.

    False where the session tells no estimate (Spark Connect): the choice is Spark's then.
    """
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return False
    estimate = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate <= _bytes(limit)


def _bytes(size: str) -> int:
    """A Spark size such as 10MB, 256k or -1."""
    digits = size.strip().lower().removesuffix("b")
    for power, unit in enumerate("kmgt", 1):
        if digits.endswith(unit):
            return int(digits[:-1]) * 1024**power
    return int(digits)


def only_keys_of(
    rows: DataFrame, keys: DataFrame, on: list[str], bounded_by: DataFrame | None = None
) -> DataFrame:
    """Drop rows whose key is not in ``keys``, if that can be done without a shuffle.

    ``bounded_by`` is a frame known to be no smaller than ``keys``, to be measured instead
    of it (Spark takes the size of a join for the product of its sides). A reduction ahead of an aggregation whose other keys would be thrown away later. Where
    the keys are too many to broadcast, all rows are kept: aggregating first then moves
    less, and a hot key stays combined on the map side.
    """
    if not fits_broadcast(keys if bounded_by is None else bounded_by):
        return rows
    return rows.join(F.broadcast(keys), on, "left_semi")


def sorted_list(df: DataFrame, *columns: str | Column, ordered: bool = True) -> DataFrame:
    """Order a list of rows, if asked for.

    A total order range-partitions the whole result and computes it once more to sample the
    ranges, so the lists that may be as long as a fact table let callers do without.
    """
    return df.orderBy(*columns) if ordered else df


def lookup(df: DataFrame, dimension: DataFrame, key: str, by: str = "id", **columns: str) -> DataFrame:
    """Add ``new_name=dimension_column`` for the dimension row whose ``by`` equals ``key``.

    Rows without a partner stay, with NULLs. No broadcast hint: Spark broadcasts the
    dimension when its estimated or measured size is under the threshold, and otherwise
    sort-merges, splitting the partitions of hot keys at run time.
    """
    ref = f"_{key}_ref"
    side = dimension.select(
        F.col(by).alias(ref), *[F.col(source).alias(name) for name, source in columns.items()]
    )
    return df.join(side, F.col(key) == F.col(ref), "left").drop(ref)


def frequent_keys(df: DataFrame, key: str, share: int) -> DataFrame:
    """Keys that hold at least one of ``share`` parts of the rows: at most ``share`` of them, whatever the size of ``df``.

    Keys are counted on the map side first, so a hot key arrives as one partial count of each task.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_rows") * share >= F.col("_all")).select(key)


def lookup_skewed(df: DataFrame, dimension: DataFrame, key: str, by: str = "id", share: int = 200, **columns: str) -> DataFrame:
    """``lookup`` for large dimensions and keys that hold much of ``df``, whatever Spark splits at run time.

    Rows of the frequent keys stay where they are and meet the few dimension rows of these keys by broadcast; a dimension has one row
    for each key here. The other rows are looked up as usual. Rows without a key or partner stay, with NULLs.
    Reads ``df`` once more to count, and the rows in two parts. The frequent keys, ``share`` at most, pass through the driver.
    """
    hot = [row[0] for row in frequent_keys(df, key, share).collect()]
    if not hot:
        return lookup(df, dimension, key, by, **columns)
    # Rows without a key need no partner either, and would meet in one task.
    apart = F.col(key).isin(hot) | F.col(key).isNull()
    few = dimension.filter(F.col(by).isin(hot))
    ref = f"_{key}_ref"
    side = few.select(F.col(by).alias(ref), *[F.col(source).alias(name) for name, source in columns.items()])
    met = df.filter(apart).join(F.broadcast(side), F.col(key) == F.col(ref), "left").drop(ref)
    return met.unionByName(lookup(df.filter(~apart), dimension.filter(~F.col(by).isin(hot)), key, by, **columns))
