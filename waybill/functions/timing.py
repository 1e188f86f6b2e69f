"""Time differences, delivery flags and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days_between(start: Column, end: Column) -> Column:
    """Completed 24-hour periods (not calendar days)."""
    return F.floor(days_between(start, end)).cast("long")


def on_time(delivered: Column, promised: Column) -> Column:
    """Delivered by the promised moment; an unknown side counts as not on time."""
    return F.coalesce(delivered <= promised, F.lit(False))


def late_label(delivered: Column, promised: Column) -> Column:
    """1 when delivered after the promise; an unknown side counts as not late."""
    return F.coalesce(delivered > promised, F.lit(False)).cast("int")


def overdue_hours(promised: Column, delivered: Column) -> Column:
    """Hours past the promise, floored at 0; unknown stays unknown."""
    hours = hours_between(promised, delivered)
    return F.when(hours.isNotNull(), F.greatest(hours, F.lit(0.0)))


def year_month(ts: Column) -> Column:
    """``yyyy-MM``; a missing timestamp gives the text ``NaT``."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("NaT"))


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def monday_first(ts: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(ts)
