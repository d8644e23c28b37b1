"""Date filters, period labels and day spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column by which ``append_ledger`` partitions, as yyyy-MM.
MONTH = "month"


def in_days(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep rows whose calendar day lies in [start, end]; either bound may be missing.

    The bounds are compared with the raw column as a half-open range, so Parquet
    statistics can use them, and with the partitions of a ledger written by month.
    """
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
        df = _from_month(df, column, F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(column) < F.date_add(F.lit(end).cast("date"), 1))
        if _by_month(df, column):
            df = df.filter(F.col(MONTH) <= F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
    return df


def _by_month(df: DataFrame, column: str) -> bool:
    return column == "transactionDate" and MONTH in df.columns


def _from_month(df: DataFrame, column: str, day: Column) -> DataFrame:
    return df.filter(F.col(MONTH) >= F.date_format(day, "yyyy-MM")) if _by_month(df, column) else df


def in_days_if_both(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """As ``in_days``, but a single bound is ignored."""
    return in_days(df, column, start, end) if start and end else df


def newest(df: DataFrame, column: str, as_of: str | None = None) -> Column:
    """The moment "now" stands for: the given one, else the newest value of the column.

    Without ``as_of`` this is a scalar subquery over that one column; pass it on large
    tables to save the extra scan and to prune partitions at planning time.
    """
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    return df.select(F.max(column)).scalar()


def last_days(df: DataFrame, column: str, days: int, as_of: str | None = None) -> DataFrame:
    """Rows from midnight ``days`` days before ``as_of`` on; later rows are all kept."""
    day = F.date_sub(F.to_date(newest(df, column, as_of)), int(days))
    return _from_month(df.filter(F.col(column) >= day), column, day)


def day_spine(df: DataFrame, column: str, days: int, as_of: str | None = None) -> DataFrame:
    """One row ``date`` per day for the ``days`` days that end with ``as_of``."""
    last = F.to_date(newest(df, column, as_of))
    offsets = df.sparkSession.range(int(days))
    return offsets.select(F.date_sub(last, (F.lit(int(days) - 1) - F.col("id")).cast("int")).alias("date"))


def week_label(column: Column) -> Column:
    """Year and Monday-based week 00-53; days before the first Monday are week 00 (not ISO)."""
    day = F.to_date(column)
    week = F.floor((F.dayofyear(day) + F.lit(6) - F.weekday(day)) / F.lit(7)).cast("int")
    return F.format_string("%04d-W%02d", F.year(day), week)


def period_label(column: Column, period: str = "day") -> Column:
    """Text label of the day, week or month; an unknown period means day."""
    if period == "month":
        return F.date_format(column, "yyyy-MM")
    if period == "week":
        return week_label(column)
    return F.date_format(column, "yyyy-MM-dd")
