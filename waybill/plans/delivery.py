"""Delivery performance: key figures, daily rate, spread of times, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybill.functions.timing import hours_between
from waybill.operators.distribution import histogram
from waybill.operators.filters import delayed_only
from waybill.plans.trends import on_time_rate, order_count


def sla_kpis(facts: DataFrame, delivered_only: bool = False) -> DataFrame:
    return facts.agg(
        on_time_rate(delivered_only),
        F.avg("delivery_time_h").alias("avg_delivery_h"),
        F.avg("delay_h").alias("avg_delay_h"),
    )


def sla_daily(facts: DataFrame) -> DataFrame:
    return (
        facts.filter(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(on_time_rate(), order_count())
        .orderBy("purchase_date")
    )


def delivery_histogram(facts: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(facts, "delivery_time_h", bins)


def delay_histogram(facts: DataFrame, bins: int = 40) -> DataFrame:
    """Only orders that were actually late."""
    return histogram(delayed_only(facts), "delay_h", bins)


def stage_times(facts: DataFrame) -> DataFrame:
    """Mean hours from purchase to approval, hand-over to the carrier, and delivery."""
    bought = F.col("order_purchase_timestamp")
    approved = F.col("order_approved_at")
    shipped = F.col("order_delivered_carrier_date")
    delivered = F.col("order_delivered_customer_date")
    return facts.groupBy("order_status").agg(
        order_count(),
        F.avg(hours_between(bought, approved)).alias("approval_h"),
        F.avg(hours_between(approved, shipped)).alias("processing_h"),
        F.avg(hours_between(shipped, delivered)).alias("shipping_h"),
        F.avg(hours_between(bought, delivered)).alias("delivery_h"),
    )
