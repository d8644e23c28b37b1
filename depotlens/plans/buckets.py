"""Tables stored in buckets of a key, so that a change reads and writes only the buckets it touches.

A bucket is a folder of Parquet files. Which bucket a row is in follows from its key alone, so the keys of a change
tell what to read, without a look into the table. The key and the number of buckets are stored with the table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.plans.durable import materialize

BUCKET = "_bucket"
#: Folders that begin with an underscore are not read as data.
LAYOUT = "_layout"


class Stored(NamedTuple):
    """A stored table: where it is, the key its rows are dealt by, the number of buckets, its columns."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: T.StructType

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or its rows in these buckets; other buckets are not opened."""
        told = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        found = self.spark.read.schema(told).parquet(self.path)
        if buckets is not None:
            found = found.filter(F.col(BUCKET).isin(list(buckets)))
        return found.drop(BUCKET)

    def touched(self, keys: DataFrame, column: str = "id") -> list[int]:
        """Buckets of these keys: as many numbers as there are buckets at most, whatever the number of keys."""
        numbers = keys.select(bucket_of(column, self.buckets).alias(BUCKET)).distinct()
        return sorted(row[0] for row in numbers.collect())

    def replace(self, version: DataFrame, buckets: Sequence[int]) -> None:
        """Put ``version`` in the place of these buckets; the others keep their files.

        The version may be made from the table itself: it is written beside it before anything is replaced. A
        row of another bucket is an error, and then nothing is replaced. A bucket without rows becomes empty.
        """
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        new = materialize(_dealt(version.select(*columns), self.key, self.buckets), "buckets")
        present = {row[0] for row in new.select(BUCKET).distinct().collect()}
        if strays := present - set(buckets):
            raise ValueError(f"rows of buckets that are not replaced: {sorted(strays)[:5]}")
        if present:
            _spread(new, self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for gone in sorted(set(buckets) - present):
            new.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={gone}")


def bucket_of(key: str, buckets: int) -> Column:
    """Bucket of a key; whole numbers of any width that print the same share one, NULL has one too."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(key, buckets))


def _spread(dealt: DataFrame, key: str) -> DataFrame:
    # Ranges over bucket, key and row: few files for a bucket, and a key with much of the table in several.
    own = F.xxhash64(*[c for c in dealt.columns if c != BUCKET])
    return dealt.repartitionByRange(BUCKET, key, own)


def write(df: DataFrame, path: str, key: str = "id", buckets: int = 256) -> Stored:
    """Store a table. ``buckets`` is also the share of the table that one changed key rewrites: one of so many."""
    spark = df.sparkSession
    _spread(_dealt(df, key, buckets), key).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path)
    layout = spark.createDataFrame([(key, buckets, df.schema.json())], "key string, buckets int, columns string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/{LAYOUT}")
    return open_stored(spark, path)


def open_stored(spark: SparkSession, path: str) -> Stored:
    key, buckets, columns = spark.read.parquet(f"{path}/{LAYOUT}").first()
    fields = T.StructType.fromJson(json.loads(columns)).fields
    return Stored(spark, path, key, buckets, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
