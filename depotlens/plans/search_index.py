"""Text search that reads candidates only: a table of three-letter runs and the rows that hold them.

A keyword of three letters or more can only be in rows that hold all its runs. Their ids are found in the
postings, which are sorted by run, so that a look-up reads few row groups; the rows are then judged by the same
predicate as without an index. Runs are taken from text folded further than any predicate folds it (whole
Unicode, both forms of the small sigma), so no row is missed by the case rules of the one or the other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 3
#: So many candidates are looked up by value, which reaches the scan; more are joined.
LISTED = 1000
SCHEMA = "gram string, id {kind}"
#: Rows whose runs one task takes; a row has some dozens of runs. Tasks grow in number with the table, not in size.
ROWS_A_TASK = 20_000


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ς", "σ")


def grams(text: Column) -> Column:
    """Distinct runs of three characters; shorter texts have none, NULL has NULL."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (LENGTH - 1), F.lit(0)))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(LENGTH)))
    return F.when(F.length(text) >= LENGTH, F.array_distinct(runs))


def postings(table: DataFrame, columns: Sequence[str], key: str = "id", shares: int = 1) -> DataFrame:
    """A row for each run and id whatever the number of columns that hold it.

    The runs of each row are dealt by id in ``shares`` before repeats are dropped: a task that read a whole small file
    would otherwise hold all of them, and shares sized by shuffled bytes are not, since runs compress well.
    """
    held = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(folded(F.col(c))), F.array().cast("array<string>")) for c in columns])))
    dealt = table.select(F.col(key).alias("id"), held.alias("_runs")).repartition(shares, "id")
    return dealt.select(F.explode("_runs").alias("gram"), "id").distinct()


def build(table: DataFrame, columns: Sequence[str], path: str, key: str = "id") -> None:
    """Postings of the text columns of a table, a row for each run and id whatever the number of columns that hold it."""
    shares = max(1, -(-table.count() // ROWS_A_TASK))
    # Ranges over run and id: a run that most rows hold is spread over several files.
    rows = postings(table, columns, key, shares)
    rows.repartitionByRange(shares, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(path)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(SCHEMA.format(kind=kind)).parquet(path)


def runs_of(keyword: str) -> list[str]:
    """Runs that a text with the keyword must hold; ``%`` and ``_`` may stand for other characters, and are in none."""
    parts = re.split("[%_]", keyword.lower().replace("ς", "σ"))
    return sorted({part[i : i + LENGTH] for part in parts for i in range(len(part) - LENGTH + 1)})


def candidates(table: DataFrame, postings: DataFrame, keyword: str | None, key: str = "id", listed: int = LISTED) -> DataFrame:
    """Rows of the table that may hold the keyword, all rows if it has no run of three.

    Few ids are told to the scan of the table by value; with ``files.write_by_id`` it then reads only their row groups.
    """
    wanted = runs_of(keyword or "")
    if not wanted:
        return table
    holding = postings.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("_held"))
    ids = holding.filter(F.col("_held") == len(wanted)).select("id")
    few = [row["id"] for row in ids.limit(listed + 1).collect()]
    if len(few) <= listed:
        return table.filter(F.col(key).isin(few))
    return table.join(ids.select(F.col("id").alias("_candidate")), F.col(key) == F.col("_candidate"), "left_semi")
