"""Text renderings of figures for display tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def currency(amount: Column, digits: int = 2, symbol: str = "$") -> Column:
    return F.concat(F.lit(symbol), F.format_number(amount, digits))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value, digits), F.lit("%"))


def rounded_percent(rate: Column) -> Column:
    """A 0..1 rate as percent with one decimal, halves to even."""
    return F.bround(rate * 100, 1)


def labelled_lines(*parts: tuple[str, Column]) -> Column:
    """``label: value`` pairs joined by ``<br>``, as used for map hints."""
    return F.concat_ws("<br>", *(F.concat(F.lit(f"{label}: "), value) for label, value in parts))
