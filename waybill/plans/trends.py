"""Sales figures: key figures, daily and monthly trend, busy hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybill.functions.casts import ratio
from waybill.functions.money import money_sum
from waybill.functions.timing import day_name, monday_first
from waybill.operators.moving import with_trailing_mean


def order_count() -> Column:
    return F.count("order_id").alias("orders")


def revenue() -> Column:
    return money_sum(F.col("gross_revenue")).alias("revenue")


def on_time_rate(delivered_only: bool = False) -> Column:
    """Share of rows on time.  Rows never delivered count as late unless only
    delivered ones are asked for."""
    hit = F.col("on_time").cast("int")
    if delivered_only:
        hit = F.when(F.col("delivery_time_h").isNotNull(), hit)
    return F.avg(hit).alias("on_time_rate")


def with_aov(df: DataFrame) -> DataFrame:
    """Average order value; null without orders."""
    return df.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))


def _totals(facts: DataFrame, *more: Column) -> DataFrame:
    row = facts.agg(F.count(F.lit(1)).alias("orders"), revenue(), *more)
    aov = F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0))
    return row.withColumn("aov", aov)


def kpis(facts: DataFrame) -> DataFrame:
    """One row: orders (fact rows), revenue, average order value, on-time rate."""
    return _totals(facts, on_time_rate())


def sales_totals(facts: DataFrame) -> DataFrame:
    """Key figures without delivery."""
    return _totals(facts)


def home_metrics(facts: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct orders, on-time percent, revenue."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return facts.agg(
        distinct("order_id").alias("orders"),
        (100 * F.avg(F.col("on_time").cast("int"))).alias("on_time_pct"),
        revenue(),
    )


def daily_trend(facts: DataFrame, rolling_days: int = 7) -> DataFrame:
    """Orders and revenue per purchase day with trailing means."""
    by_day = (
        facts.filter(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(order_count(), revenue())
    )
    if not rolling_days:
        return by_day.orderBy("purchase_date")
    return with_trailing_mean(by_day, "purchase_date", ["orders", "revenue"], rolling_days)


def monthly_trend(facts: DataFrame) -> DataFrame:
    return with_aov(facts.groupBy("ym").agg(order_count(), revenue())).orderBy("ym")


def busy_hours(facts: DataFrame) -> DataFrame:
    """Orders per day of week and hour, Monday first."""
    ts = F.col("purchase_dt")
    return (
        facts.filter(ts.isNotNull())
        .groupBy(monday_first(ts).alias("dow_index"), F.hour(ts).alias("hour"), day_name(ts).alias("dow"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("dow_index", "hour")
    )


def busy_hours_grid(facts: DataFrame) -> DataFrame:
    """The same as a 7 x 24 grid, one column per hour; an empty cell is 0."""
    return (
        busy_hours(facts)
        .groupBy("dow_index", "dow")
        .pivot("hour", list(range(24)))
        .agg(F.sum("orders"))
        .fillna(0)
        .orderBy("dow_index")
    )
