"""Trailing means over an ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def with_trailing_mean(
    series: DataFrame, order: str, columns: Sequence[str], rows: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<column>_ma``: the mean of this and the ``rows - 1`` rows before.

    Row based (gaps in ``order`` are not filled); null until ``rows`` rows, all
    with a value, are in the frame.  Meant for a series that is already
    aggregated, one row per day; ``by`` separates several series.
    """
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return series.withColumns(
        {
            f"{c}_ma": F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame))
            for c in columns
        }
    )
