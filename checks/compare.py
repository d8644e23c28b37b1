"""Compare registered queries with their SQL: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import queries

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else repr(v + 0.0) if isinstance(v, float) else str(v) for v in row)
            for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None if both engines agree on columns and rows."""
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = pd.DataFrame(cursor.fetchall(), columns=names, dtype=object)
    result = queries()[name](spark, folder)
    actual = pd.DataFrame([tuple(r) for r in result.collect()], columns=result.columns, dtype=object)
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(set(actual.columns) ^ set(expected.columns))}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    for ours, theirs in zip(canonical(actual), canonical(expected)):
        if ours != theirs:
            return f"{sorted(actual.columns)}\n   ours {ours}\n theirs {theirs}"
    return None


def main() -> None:
    folder, chosen = sys.argv[1], sys.argv[2:]
    scratch = tempfile.mkdtemp(prefix="run-")  # one process on one machine
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    missing = set(queries()) ^ set(oracle_sql())
    for name in chosen or list(queries()):
        if name in missing:
            print("no pair", name)
            continue
        begun = time.time()
        try:
            found = difference(spark, con, folder, name)
        except Exception as error:  # reported, so that the other queries still run
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - begun:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
