"""Totals of a parent joined with several of its children at once.

Joining a warehouse with its products, locations and ledger rows repeats every ledger row
(products x locations) times, and the totals the original application reports contain
that factor. Here each child is aggregated alone and the factor is multiplied in, which
gives the same totals without building the product of the children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("reference", "exact")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def with_child_count(parents: DataFrame, children: DataFrame, foreign_key: str, name: str) -> DataFrame:
    """Add the number of children per parent id (0 if none)."""
    counts = (
        children.filter(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).alias("_parent"))
        .agg(F.count("*").alias(name))
    )
    return parents.join(counts, F.col("id") == F.col("_parent"), "left").drop("_parent").fillna(0, subset=[name])


def repeats(mode: str, *child_counts: str) -> Column:
    """How often a row is repeated by its siblings; a childless sibling still leaves one."""
    check_mode(mode)
    factor = F.lit(1).cast("bigint")
    if mode == "reference":
        for name in child_counts:
            factor = factor * F.greatest(F.col(name), F.lit(1))
    return factor
