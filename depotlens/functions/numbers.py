"""Sums that do not depend on row order, and the rounding rules of the reports."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Double sums differ in the last digits with partition order, so a retried task could change a
# report. These sums cannot: an amount is cut into whole numbers (nine places, about what a double
# holds beside amounts of some millions) that are summed as bigints, which a hot key cannot overflow.
# Decimals only put the three sums together. As the parts are plain sums, they also
# add up across stored partial results, and those of removed rows can be taken off again.
PLACES = 9
UNIT = 10**PLACES
HIGH_BITS = 20
LOW_BITS = 25
#: Beyond this a double has no fraction and steps of hundreds; such amounts are summed as doubles.
LARGEST = float(1 << 62)

PARTS = ("high", "middle", "low", "large")
PARTS_TYPE = "struct<high:bigint,middle:bigint,low:bigint,large:double>"


def parts_of(amount: Column) -> dict[str, Column]:
    """The numbers to be summed for an amount.

    ``high`` counts 2**HIGH_BITS; the rest, in thousand-millionths, is ``middle`` * 2**LOW_BITS + ``low``.
    """
    amount = amount.cast("double")
    usual = F.when(F.abs(amount) < LARGEST, amount)
    whole = F.floor(usual)
    fraction = F.rint((usual - whole) * F.lit(float(UNIT))).cast("bigint")
    rest = whole.bitwiseAND(F.lit((1 << HIGH_BITS) - 1).cast("bigint")) * F.lit(UNIT) + fraction
    return {
        "high": F.shiftright(whole, HIGH_BITS),
        "middle": F.shiftright(rest, LOW_BITS),
        "low": rest.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint")),
        "large": F.when(F.abs(amount) >= LARGEST, amount),
    }


def total_of(sums: Mapping[str, Column]) -> Column:
    """The amount that summed parts stand for; NULL if nothing was summed."""
    high, middle, low = (sums[part].cast("decimal(19,0)") for part in PARTS[:3])
    whole = high * F.lit(Decimal(1 << HIGH_BITS)).cast("decimal(7,0)")
    rest = (middle * F.lit(Decimal(1 << LOW_BITS)).cast("decimal(8,0)") + low).cast("decimal(28,0)")
    total = (whole + (rest * F.lit(Decimal(1).scaleb(-PLACES))).cast("decimal(30,9)")).cast("double")
    large = sums["large"]
    return F.when(large.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + large)


def exact_sum(amount: Column) -> Column:
    """SUM over ledger-line amounts; NULL when there is nothing to add."""
    return total_of({part: F.sum(value) for part, value in parts_of(amount).items()})


def exact_total(amount: Column) -> Column:
    """SUM over already aggregated amounts, which may be far larger than one line."""
    amount = amount.cast("double")
    usual = F.sum(F.when(F.abs(amount) < 1e19, amount).cast(f"decimal(28,{PLACES})")).cast("double")
    large = F.sum(F.when(F.abs(amount) >= 1e19, amount))
    return F.when(large.isNull(), usual).otherwise(F.coalesce(usual, F.lit(0.0)) + large)


def exact_multiple(amount: Column, factor: Column) -> Column:
    """Amount times a whole number, free of binary rounding in between."""
    small = (F.abs(amount) < 1e17) & (factor < 10**10)
    usual = F.when(small, amount).cast(f"decimal(27,{PLACES})") * F.when(small, factor).cast("decimal(10,0)")
    return F.when(small, usual.cast("double")).otherwise(amount * factor)


def exact_avg(amount: Column) -> Column:
    return exact_sum(amount) / F.count(amount)


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def ratio(numerator: Column, denominator: Column, factor: float = 1.0, digits: int = 2) -> Column:
    """Rounded numerator/denominator*factor; 0.0 unless the denominator is positive."""
    value = zero_if_null(numerator) / denominator * F.lit(factor)
    return F.when(denominator > 0, F.round(value, digits)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 100.0)


def round_half_up(column: Column) -> Column:
    """Whole number, .5 always towards positive infinity (as browsers round)."""
    return F.floor(column + F.lit(0.5)).cast("double")
