"""Shares of a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybill.functions.casts import ratio


def share_pct(value: str) -> Column:
    """Percent of the column's total over a grouped result.

    The window spans the whole table, which is only right for a result that is
    already grouped to one row per category.
    """
    return 100 * ratio(F.col(value), F.sum(value).over(Window.partitionBy()))


def with_share(grouped: DataFrame, value: str, name: str = "share_pct") -> DataFrame:
    return grouped.withColumn(name, share_pct(value))
