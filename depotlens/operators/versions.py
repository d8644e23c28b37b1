"""Changes of stored tables that read and write only what they touch.

The rules are those of ``batch``; here they meet the touched buckets of a table (``plans.buckets``) or the touched months of a
ledger instead of the whole. A change that was cut off can be done again and ends in the same tables.
Changes are written first: they may come from the table itself, and Spark then knows their size, so that few of them are
broadcast and the table is not shuffled. What is returned is written too, as the files it was made from are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.operators import batch
from depotlens.plans.buckets import Stored
from depotlens.plans.durable import materialize
from depotlens.plans.snapshot import month_of
from depotlens.sources.files import replace_months


def upsert(stored: Stored, changes: DataFrame, entity: str, insert: bool = False) -> DataFrame:
    """``batch.upsert_latest`` on a table stored by ``id``; returns the rejected changes."""
    changes = materialize(changes, "changes")
    buckets = stored.touched(changes)
    version, rejected = batch.upsert_latest(stored.rows(buckets), changes, entity, insert)
    rejected = materialize(rejected, "rejected")
    stored.replace(version, buckets)
    return rejected


def replace_children(invoices: Stored, items: Stored, new_items: DataFrame, tax_rate: float | None = None) -> DataFrame:
    """``batch.replace_children`` on invoices stored by ``id`` and items stored by ``invoiceId``; returns the rejected items."""
    new_items = materialize(new_items, "new-items")
    heads, children = invoices.touched(new_items, "invoiceId"), items.touched(new_items, "invoiceId")
    versions = batch.replace_children(invoices.rows(heads), items.rows(children), new_items, tax_rate)
    rejected = materialize(versions[2], "rejected")
    # The items first: done again after that, they are replaced by themselves, and the totals follow from the new items alone.
    items.replace(versions[1], children)
    invoices.replace(versions[0], heads)
    return rejected


def plain_delete(stored: Stored, ids: DataFrame) -> DataFrame:
    """``batch.plain_delete`` on a table stored by ``id``; returns the unknown ids."""
    ids = materialize(ids.select("id"), "deleted-ids")
    buckets = stored.touched(ids)
    kept, unknown = batch.plain_delete(stored.rows(buckets), ids)
    unknown = materialize(unknown, "rejected")
    stored.replace(kept, buckets)
    return unknown


def guarded_delete(tables: Mapping[str, DataFrame], entity: str, stored: Stored, ids: DataFrame) -> DataFrame:
    """``batch.guarded_delete`` on a table stored by ``id``, guarded by ``tables``; returns the ids that are held, with their counts."""
    buckets = stored.touched(ids)
    kept, held = batch.guarded_delete({**{name: tables[name] for name, _, _ in batch.GUARDS[entity]}, entity: stored.rows(buckets)}, entity, ids)
    held = materialize(held, "rejected")
    stored.replace(kept, buckets)
    return held


def cascade_delete(invoices: Stored, items: Stored, ids: DataFrame) -> DataFrame:
    """``batch.cascade_delete`` on invoices stored by ``id`` and items stored by ``invoiceId``; returns the unknown ids."""
    ids = materialize(ids.select("id"), "deleted-ids")
    heads, children = invoices.touched(ids), items.touched(ids)
    versions = batch.cascade_delete(invoices.rows(heads), items.rows(children), ids)
    unknown = materialize(versions[2], "rejected")
    # The items first, so that an invoice is there as long as an item is.
    items.replace(versions[1], children)
    invoices.replace(versions[0], heads)
    return unknown


def _held_months(ledger: DataFrame, ids: DataFrame) -> set[str]:
    """Months with lines of these ids; reads two columns of the ledger."""
    held = ledger.select("id", "month").join(ids.select("id"), "id", "left_semi")
    return {row[0] for row in held.select("month").distinct().collect()}


def _of_months(ledger: DataFrame, months: list[str]) -> DataFrame:
    return ledger.filter(F.col("month").isin(months)).drop("month")


def upsert_ledger(ledger: DataFrame, path: str, changes: DataFrame, insert: bool = False) -> tuple[DataFrame, list[str]]:
    """(rejected changes, months replaced) of ``batch.upsert_latest`` on a ledger stored by month in ``path``.

    Months are those that hold a changed line now and those that a change moves one to. ``snapshot.refresh`` with
    these months brings stored partial sums up to date.
    """
    changes = materialize(changes, "changes")
    date = F.col("updatedAt")
    if "transactionDate" in changes.columns:
        date = F.coalesce("transactionDate", date)
    moved = changes.select(date.alias("transactionDate")).select(month_of()).distinct()
    months = sorted(_held_months(ledger, changes) | {row[0] for row in moved.collect()})
    version, rejected = batch.upsert_latest(_of_months(ledger, months), changes, "transactions", insert)
    rejected = materialize(rejected, "rejected")
    if months:
        replace_months(version, path, months)
    return rejected, months


def delete_from_ledger(ledger: DataFrame, path: str, ids: DataFrame) -> tuple[DataFrame, list[str]]:
    """(unknown ids, months replaced) of ``batch.plain_delete`` on a ledger stored by month in ``path``."""
    ids = materialize(ids.select("id"), "deleted-ids")
    months = sorted(_held_months(ledger, ids))
    kept, unknown = batch.plain_delete(_of_months(ledger, months), ids)
    unknown = materialize(unknown, "rejected")
    if months:
        replace_months(kept, path, months)
    return unknown, months
