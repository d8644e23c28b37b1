"""Reading tables and documents, writing results."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.plans.durable import materialize
from depotlens.plans.snapshot import month_of
from depotlens.schemas import DOCUMENTS, TABLES

BROKEN = "_broken_line"


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables ``<folder>/<name>`` with the declared schemas, also as temp views."""
    tables = {}
    for name in names or list(TABLES):
        tables[name] = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
        tables[name].createOrReplaceTempView(name)
    return tables


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stock slips from JSON lines; no inference pass over the files. Broken lines are left out (``sound_documents`` tells them)."""
    return sound_documents(spark, path)[0]


def sound_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected lines as ``line`` with a ``reject_reason``) of JSON lines.

    A line is rejected as a whole if it is no JSON object, or if one of its values is not of the declared type; nothing of it
    is used. Fields that are missing are NULL, unknown ones are ignored, blank lines are skipped.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")
    told = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    parsed = lines.withColumn("document", F.from_json("line", told, options))
    broken = F.col(f"document.{BROKEN}").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    rejected = parsed.filter(broken).select("line", F.lit("not a document").alias("reject_reason"))
    return parsed.filter(~broken).select("document.*").drop(BROKEN), rejected


def append_ledger(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append ledger rows, partitioned by month of their date.

    Rows are range-partitioned by date and id first: a task then writes few months, and a
    day that holds much of the data still spreads over several tasks. Rows of a named ``batch`` have a
    folder of their own that is replaced as a whole, so an append can be repeated, or done again after a failure, without
    doubling a row. Ledgers are appended to with names or without, not both.
    """
    dealt = rows.withColumn("month", month_of()).repartitionByRange("transactionDate", "id")
    if batch is None:
        dealt.write.mode("append").partitionBy("month").parquet(path)
    else:
        dealt.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={quote(batch, safe='')}")


def replace_months(version: DataFrame, path: str, months: Sequence[str]) -> None:
    """Overwrite these months of a ledger stored by month with those of a new version; other months keep their files.

    The version may be made from the stored ledger itself: its rows are written beside it before anything is replaced. A month that
    has no rows left becomes empty.
    """
    spark = version.sparkSession
    plain = version.drop("month")
    new = materialize(plain.filter(month_of().isin(*months)).withColumn("month", month_of()), "ledger-months")
    marks = spark.createDataFrame([(m,) for m in months], "month string")
    # A month without rows is replaced by a file without rows: its one mark is dropped again when it is read.
    gone = [row["month"] for row in marks.join(new.select("month").distinct(), "month", "left_anti").collect()]
    (
        new.repartitionByRange("month", "transactionDate", "id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    )
    for month in gone:
        plain.limit(0).write.mode("overwrite").parquet(f"{path}/month={month}")


def write_by_id(df: DataFrame, path: str, key: str = "id", partitions: int | None = None) -> None:
    """Parquet in ranges of the key, sorted, with Bloom filters on it: a look-up by id opens a file and reads a row group.

    ``partitions`` is the number of ranges, by default Spark's choice by size.
    """
    ordered = df.repartitionByRange(*[partitions] if partitions else [], key).sortWithinPartitions(key)
    ordered.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, every field quoted and quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NULL fields are written too."""
    df.write.option("ignoreNullFields", False).json(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """The lines ``write_csv`` would write, without the header, in a column ``line``."""

    def quoted(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return df.select(F.concat_ws(",", *[quoted(c) for c in df.columns]).alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    """Every row as one JSON object, in a column ``json``."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(row.alias("json"))
