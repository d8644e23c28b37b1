"""Small helpers that several text operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose nodes lack that folder gets the package with ``--py-files`` as usual.
    """
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *known])


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def size_of(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
