"""Stock sign rule, text matching and optional filters."""

from __future__ import annotations

import string
from functools import reduce
from itertools import product as variants
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed_quantity() -> Column:
    """Only inbound rows add stock; every other type (also none at all) subtracts."""
    return F.when(F.col("type") == "inbound", F.col("quantity")).otherwise(-F.col("quantity"))


def line_value() -> Column:
    return F.col("quantity") * F.col("unitPrice")


def of_type(kind: str, amount: Column) -> Column:
    """The amount on rows of that type, 0 on all others (NULL amounts stay NULL)."""
    return F.when(F.col("type") == kind, amount).otherwise(F.lit(0.0))


def where_equal(df: DataFrame, **wanted: Any) -> DataFrame:
    """AND of optional equality filters; None and '' mean "no filter"."""
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    return df


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def like_ascii(column: str, term: str) -> Column:
    """``column LIKE '%term%'`` folding only A-Z; % and _ in the term stay wildcards."""
    folded = F.translate(F.col(column), string.ascii_uppercase, string.ascii_lowercase)
    pattern = term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return folded.like("%" + pattern.replace("\\", "\\\\") + "%")


def starts_with_ascii(column: str, prefix: str) -> Column:
    """Prefix test folding A-Z, as an OR of literal prefixes that scans can push down."""
    spellings = variants(*({c.lower(), c.upper()} for c in prefix))
    return any_of([F.col(column).startswith("".join(s)) for s in sorted(spellings)])


def contains_folded(column: str, term: str) -> Column:
    """Substring test folding all of Unicode; NULL never matches."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lower(F.lit(term))), F.lit(False))


def or_default(column: Column, default: Any) -> Column:
    """``value || default`` for text: NULL and '' are replaced."""
    return F.when(column.isNull() | (column == ""), F.lit(default)).otherwise(column)


def is_blank(df: DataFrame, name: str) -> Column:
    """NULL, '', 0, false and the empty array; a column the frame lacks is blank."""
    if name not in df.columns:
        return F.lit(True)
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        empty = column == ""
    elif isinstance(kind, T.NumericType):
        empty = column == 0
    elif isinstance(kind, T.BooleanType):
        empty = ~column
    elif isinstance(kind, T.ArrayType):
        empty = F.size(column) == 0
    else:
        empty = F.lit(False)
    return column.isNull() | empty


def stock_status(on_hand: Column, minimum: Column, maximum: Column) -> Column:
    """low is tested before high, so min = max = on-hand is low."""
    return F.when(on_hand <= minimum, "low").when(on_hand >= maximum, "high").otherwise("normal")
