"""Row filters and the bounds they default to."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from waybill.functions.casts import to_number


def date_bounds(facts: DataFrame) -> DataFrame:
    """One row: first and last purchase date."""
    return facts.agg(
        F.min("purchase_date").alias("min_date"), F.max("purchase_date").alias("max_date")
    )


def _midnight(day: date) -> Column:
    return F.lit(datetime(day.year, day.month, day.day).isoformat(sep=" ")).cast("timestamp")


def in_period(facts: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows purchased from ``start`` to ``end``, both days included.

    Written as a range on the stored timestamp, so that it reaches the Parquet
    reader, and on ``ym``, so that it prunes folders of a table partitioned by
    month.  A missing purchase time is outside every period.
    """
    ts = F.col("purchase_dt")
    kept = facts.filter(ts.isNotNull())
    if start is not None:
        kept = kept.filter(ts >= _midnight(start))
    if end is not None:
        kept = kept.filter(ts < _midnight(end + timedelta(days=1)))
    if "ym" in facts.columns:
        if start is not None:
            kept = kept.filter(F.col("ym") >= F.lit(f"{start:%Y-%m}"))
        if end is not None:
            kept = kept.filter(F.col("ym") <= F.lit(f"{end:%Y-%m}"))
    return kept


def in_year(df: DataFrame, year: int | None, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Rows of one calendar year, as a timestamp range; no year means no filter."""
    if not year:
        return df
    return df.filter(
        (F.col(ts) >= _midnight(date(year, 1, 1))) & (F.col(ts) < _midnight(date(year + 1, 1, 1)))
    )


def last_year_only(facts: DataFrame, ts: str = "purchase_dt") -> DataFrame:
    """Rows of the last calendar year present."""
    start_of_last = facts.agg(F.date_trunc("year", F.max(ts))).scalar()
    return facts.filter(F.col(ts) >= start_of_last)


def with_status(df: DataFrame, status: str) -> DataFrame:
    return df.filter(F.col("order_status") == status)


def late_only(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("on_time"))


def delayed_only(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("delay_h") > 0)


def is_complete(*columns: str) -> Column:
    """Whether every named column holds a number."""
    known = F.lit(True)
    for name in columns:
        known = known & to_number(F.col(name)).isNotNull()
    return known


def complete_in(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a number in every named column."""
    return df.filter(is_complete(*columns))
