"""Distinct counts over time that merge: one bit for each value, in maps by day.

A count of distinct values of a month cannot be added up from days, but maps of bits can be merged. The state
holds a map of 32,768 bits for each day and block of ids that occurs, made in one shuffle of narrow rows; months, ranges and the whole
are merged from it and need the ledger no more. Counts are exact. Values are whole-number ids; other keys are numbered first
(``numbered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(``column``, ``number``) of the distinct values: numbers are unique, not gapless, and made without a global order."""
    return values.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("number", F.monotonically_increasing_id())


def bit_maps(rows: DataFrame, value: str, by: dict[str, Column]) -> DataFrame:
    """The state: the columns ``by``, ``block`` and ``bits``. NULL values count nowhere, as in COUNT(DISTINCT)."""
    known = rows.filter(F.col(value).isNotNull())
    placed = known.select(*[c.alias(n) for n, c in by.items()], F.bitmap_bucket_number(value).alias("block"), F.bitmap_bit_position(value).alias("_bit"))
    # Equal rows are dropped on the map side, so a hot day or product arrives as a few rows.
    return placed.distinct().groupBy(*by, "block").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged(state: DataFrame, by: dict[str, Column]) -> DataFrame:
    """The state of coarser groups."""
    return state.select(*[c.alias(n) for n, c in by.items()], "block", "bits").groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(state: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct values of each group of the state."""
    return state.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))
