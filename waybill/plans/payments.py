"""Payment methods and instalment plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybill.functions.present import currency, percent
from waybill.operators.sharing import with_share
from waybill.plans.trends import order_count, revenue, with_aov


def by_type(facts: DataFrame) -> DataFrame:
    """Orders, revenue, instalments, order value and share per payment type."""
    grouped = facts.groupBy("payment_type").agg(
        order_count(),
        revenue(),
        F.avg("installments").alias("installments_avg"),
        F.max("installments").alias("installments_max"),
    )
    return with_share(with_aov(grouped), "orders").orderBy(F.desc("revenue"), "payment_type")


def breakdown(facts: DataFrame) -> DataFrame:
    """The short form without instalments."""
    grouped = facts.groupBy("payment_type").agg(order_count(), revenue())
    return with_share(with_aov(grouped), "orders").orderBy(F.desc("revenue"), "payment_type")


def by_installments(facts: DataFrame) -> DataFrame:
    grouped = facts.groupBy("installments").agg(order_count(), revenue())
    return with_share(with_aov(grouped), "orders").orderBy(F.desc("orders"), "installments")


def by_installments_value(facts: DataFrame) -> DataFrame:
    """The same figures, highest average order value first."""
    return by_installments(facts).orderBy(F.desc("aov"), "installments")


def present_by_type(table: DataFrame) -> DataFrame:
    """``by_type`` with its figures rendered as text."""
    return table.select(
        "payment_type",
        "orders",
        currency(F.col("revenue"), 0).alias("revenue"),
        F.format_number("installments_avg", 2).alias("installments_avg"),
        "installments_max",
        currency(F.col("aov"), 2).alias("aov"),
        percent(F.col("share_pct")).alias("share_pct"),
    )
