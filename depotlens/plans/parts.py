"""Nesting of child rows in arrays of limited length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.plans.durable import materialize
from depotlens.plans.lookups import fits_broadcast


def _with_items(df: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """Add ``_items``, the number of children of a large parent, NULL for others."""
    side = F.broadcast(large) if fits_broadcast(large) else large
    return df.join(side, F.col(key) == F.col("_large"), "left").drop("_large")


def _paged(lines: DataFrame, key: str, limit: int) -> DataFrame:
    """Lines of large parents with their ``_part``: ``limit`` each, in the order of the elements.

    Ranges of (key, element, hash) are numbered apart and added up, so that no task holds a parent.
    """
    ranged = lines.repartitionByRange(key, "_element", "_hash").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "large-children")
    within = Window.partitionBy(key, "_range").orderBy("_element", "_hash")
    before = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_in")).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = ranged.withColumn("_number", F.row_number().over(within) - 1)
    met = numbered.join(starts, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_in")))
    part = F.floor((F.col("_start") + F.col("_number")) / F.lit(limit)).cast("int")
    return met.select(key, "_element", part.alias("_part"))


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    key: str,
    element: Column,
    name: str,
    spread_by: list[str],
    limit: int,
) -> DataFrame:
    """Parents (by ``id``) with the sorted array of their children's elements.

    The shape is the same for any size: ``part``, ``partCount``, ``itemCount`` (of the whole parent) and the
    array. Every parent has ``part`` 0; ``limit`` is the page size, so part k holds the elements
    from k * ``limit`` on, and no task has to hold a whole hot parent: neither the grouping nor the join
    is by ``key`` alone. ``spread_by`` tells equal elements apart. The children are counted first, in a job
    of its own; without any large parent the rest is one plain grouping.
    """
    counts = children.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("_items"))
    large = materialize(counts.filter(F.col("_items") > limit), "large-parents")
    lines = children.select(key, element.alias("_element"), F.xxhash64(*spread_by).alias("_hash"))
    whole = F.lit(0).alias("_part")
    if large.isEmpty():
        placed = lines.select(key, "_element", whole)
        wanted = parents.withColumn("_items", F.lit(None).cast("bigint"))
    else:
        sized = _with_items(lines, key, large)
        small = sized.filter("_items IS NULL").select(key, "_element", whole)
        placed = small.unionByName(_paged(sized.filter("_items IS NOT NULL").drop("_items"), key, limit))
        # Explicit: a join by key has already brought the rows of a key together.
        placed = placed.repartition(F.col(key), F.col("_part"))
        wanted = _with_items(parents, "id", large)
    nested = placed.groupBy(key, "_part").agg(F.array_sort(F.collect_list("_element")).alias(name))
    parts = F.coalesce(F.ceil(F.col("_items") / F.lit(limit)).cast("int"), F.lit(1))
    wanted = wanted.withColumn("partCount", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("partCount") - 1)))
    met = (F.col("id") == F.col(key)) & (F.col("part") == F.col("_part"))
    empty = F.array().cast(nested.schema[name].dataType)
    joined = wanted.join(nested, met, "left").withColumn(name, F.coalesce(F.col(name), empty))
    items = F.coalesce("_items", F.size(name).cast("bigint"))
    return joined.select(*parents.columns, "part", "partCount", items.alias("itemCount"), name)


def heads(documents: DataFrame) -> DataFrame:
    """One row per document: of those in parts the first."""
    return documents.filter("part = 0") if "part" in documents.columns else documents
