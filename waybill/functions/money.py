"""Money sums that do not depend on the order of the rows.

Money is held as double but summed as whole units and millionths in two longs, so a
total does not depend on the order in which partitions arrive, stays inside
whole-stage code generation and, under ANSI mode, raises instead of wrapping around.
Amounts keep ``DECIMALS`` decimals; an amount that is not a number is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waybill.functions.casts import to_number

# Decimals of an amount that count; what is beyond them is rounded once per amount.
DECIMALS = 6


def cents(amount: Column) -> Column:
    """Whole cents, for a source whose amounts are declared in cents."""
    return F.rint(to_number(amount) * 100).cast("long")


def from_cents(total: Column) -> Column:
    return total / F.lit(100.0)


def money_parts(amount: Column) -> tuple[Column, Column]:
    """Sums of whole units and of millionths; stored, they can be added up further."""
    known = to_number(amount)
    return (
        F.sum(F.floor(known).cast("long")),
        F.sum(F.rint((known - F.floor(known)) * float(10**DECIMALS)).cast("long")),
    )


def money_total(units: Column, parts: Column) -> Column:
    """The amount that units and millionths make; nothing makes 0, not null."""
    scale = float(10**DECIMALS)
    return F.coalesce((units * scale + parts) / scale, F.lit(0.0))


def money_sum(amount: Column) -> Column:
    """Sum of an amount column; a sum over nothing is 0, not null."""
    return money_total(*money_parts(amount))


def money_sum_where(condition: Column, amount: Column) -> Column:
    return money_sum(F.when(condition, amount))
