"""Exact duplicates through a persistent index of digests.

The index is a table of one row per distinct text, bucketed and sorted by its digest. New data
is grouped by digest, its groups meet the index in a sort-merge anti-join without moving the
index, and what is new is appended. Only digests and ids are shuffled, never texts, and a text
with a third of all rows arrives at its group as one partial row per task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm.workers import text_or_empty
from depotlens.plans.durable import materialize, new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INDEX_SCHEMA = "digest binary, keep_id bigint"
#: Rows of an index bucket are meant to fit in one task's sort.
ROWS_PER_BUCKET = 2_000_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class DigestIndex:
    """A table (digest, keep_id) in ``path``, bucketed and sorted by digest.

    The number of buckets is kept beside the files. An index that is opened again has that number, whatever is asked
    for: files are read by bucket, and under another number known texts would not be found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, self._settled(spark, f"{path}-buckets", buckets)
        buckets = self.buckets
        self.table = "digest_index_" + "".join(c if c.isalnum() else "_" for c in path[-48:])
        columns = INDEX_SCHEMA.replace("digest binary", "digest BINARY").replace("keep_id bigint", "keep_id BIGINT")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @staticmethod
    def _settled(spark: SparkSession, path: str, buckets: int) -> int:
        """The number in ``path``, or ``buckets``, which then stands there."""
        try:
            known = spark.read.schema("buckets int").parquet(path).first()
        except AnalysisException:  # there is no such path yet
            known = None
        if known is None:
            spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(path)
        return buckets if known is None else known["buckets"]

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """``groups`` must hold digests that the index does not have yet."""
        (
            groups.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .mode("append")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. Of equal
    texts that the index does not hold yet, the row with the largest ``doc_id`` stays and is
    appended to the index; if the index holds the text, all new rows go and ``keep_id`` is the
    id kept then. ``group_size`` counts the rows of ``docs``. Rows that share id and text
    are one document: they stay or go together. A NULL id is smaller than any other. Other columns are
    ignored; an empty table gives an empty result.

    Without ``index`` a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    own = materialize(digests(docs), "digests")
    if index is None:
        buckets = max(4, -(-own.count() // ROWS_PER_BUCKET))
        index = DigestIndex(spark, new_path(spark, "digest-index"), buckets)
    groups = materialize(
        own.groupBy("digest").agg(
            F.max("doc_id").alias("newest"),
            F.count("*").alias("group_size"),
        ),
        "digest-groups",
    )
    known = index.read()
    new = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
    index.append(new.select("digest", F.col("newest").alias("keep_id")))
    settled = groups.join(index.read(), "digest").select(
        F.col("digest").alias("_digest"),
        "keep_id",
        "group_size",
        F.col("newest").eqNullSafe(F.col("keep_id")).alias("_may_stay"),
    )
    # Both sides are exchanged, so that Spark can split the rows of a hot text.
    rows = own.join(settled, F.col("digest") == F.col("_digest"))
    candidate = F.col("_may_stay") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", candidate.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
