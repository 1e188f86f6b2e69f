"""Casts that turn unreadable values into nulls, and null fills."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(col: Column, fill: float | None = None) -> Column:
    """Read a column as double; unreadable or missing values become ``fill``."""
    number = F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def to_timestamp(col: Column) -> Column:
    """Read a column as timestamp; unreadable values become null."""
    return col.try_cast("timestamp")


def to_count(col: Column, fill: int) -> Column:
    """Read a column as a whole number, truncating, with missing as ``fill``."""
    return to_number(col, fill).cast("int")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null when ``whole`` is zero (ANSI division would raise)."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
