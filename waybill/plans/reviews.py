"""Review scores and how delivery relates to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybill.functions.casts import ratio
from waybill.functions.present import rounded_percent
from waybill.operators.distribution import box_stats
from waybill.operators.sharing import with_share
from waybill.plans.trends import on_time_rate, order_count


def review_kpis(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.avg("review_score").alias("avg_score"),
        on_time_rate(),
        F.avg("delay_h").alias("avg_delay_h"),
    )


def distribution(facts: DataFrame) -> DataFrame:
    """Orders and share per score; orders without a score are a group of their own."""
    grouped = facts.groupBy("review_score").agg(F.count(F.lit(1)).alias("orders"))
    return with_share(grouped, "orders").orderBy(F.col("review_score").asc_nulls_last())


def by_score(facts: DataFrame) -> DataFrame:
    """Delivery figures per score, the missing score last."""
    return (
        facts.groupBy("review_score")
        .agg(
            order_count(),
            on_time_rate(),
            F.avg("delivery_time_h").alias("delivery_time_h"),
            F.avg("delay_h").alias("delay_h"),
        )
        .orderBy(F.col("review_score").asc_nulls_last())
    )


def present_by_score(table: DataFrame) -> DataFrame:
    return table.select(
        "review_score", "orders",
        rounded_percent(F.col("on_time_rate")).alias("on_time_pct"),
        "delivery_time_h", "delay_h",
    )


def delivery_box(facts: DataFrame) -> DataFrame:
    """Box-plot figures of the delivery time per score."""
    return box_stats(facts, "delivery_time_h", ["review_score"])


def promoter_score(facts: DataFrame) -> DataFrame:
    """Share of top scores (5) minus share of low scores (1 to 3), in points."""
    score = F.col("review_score")
    return facts.agg(
        F.count(score).alias("scored"),
        F.count_if(score == 5).alias("promoters"),
        F.count_if(score <= 3).alias("detractors"),
    ).withColumn(
        "nps", 100 * ratio(F.col("promoters") - F.col("detractors"), F.col("scored"))
    )
