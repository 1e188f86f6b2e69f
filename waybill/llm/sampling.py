"""Bounded, repeatable samples of rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sample(rows: DataFrame, total: int, most: int, *columns: str, text: Column) -> list:
    """About ``most`` of the ``total`` rows, the same ones each time; never more.

    Rows are kept by a hash of id and text, so those with the same id need not all be
    drawn.  The threshold leaves each task a few rows; the final order is a top-k.
    """
    drawn = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), text), F.lit(1 << 30))
    share = min(1.0, 1.5 * most / max(total, 1))
    kept = rows.withColumn("_drawn", drawn).filter(F.col("_drawn") < int(share * (1 << 30)))
    return kept.orderBy("_drawn", "doc_id").limit(most).select(*columns).collect()


def sample_of_each(rows: DataFrame, group: str, most: int, *columns: str, text: Column) -> list:
    """At most ``most`` rows of each value of ``group``, the same ones each time.

    A hash keeps about 1.5 times as many of each value before they are ranked, so no
    task ranks more than that, however large a group is.
    """
    shares = rows.groupBy(group).count().select(
        F.col(group).alias("_group"), F.least(F.lit(1.0), 1.5 * most / F.col("count")).alias("_share")
    )
    drawn = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), text), F.lit(1 << 30))
    joined = rows.join(shares, rows[group] == F.col("_group")).withColumn("_drawn", drawn)
    kept = joined.filter(F.col("_drawn") < F.col("_share") * (1 << 30))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_drawn", "doc_id"))
    order = (group, "_drawn", "doc_id")
    return kept.withColumn("_place", place).filter(F.col("_place") <= most).orderBy(*order).select(*columns).collect()
