"""Reading small results in tests."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df, *columns):
    """Rows as tuples, in the order of the frame."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def by(df, key, *columns):
    """{key: value or tuple of values}"""
    found = {}
    for row in df.select(key, *columns).collect():
        found[row[0]] = row[1] if len(columns) == 1 else tuple(row)[1:]
    return found
