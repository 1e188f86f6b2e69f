"""The order fact table: orders enriched with items, payments, reviews, customers."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from waybill.functions.money import money_sum
from waybill.functions.timing import hours_between, on_time, overdue_hours, year_month
from waybill.operators.filters import in_year
from waybill.operators.skew import left_join_apart
from waybill.operators.topk import newest
from waybill.schemas import FACT_COLUMNS, ORDER_COLUMNS
from waybill.sources.tables import Sources

ITEM_COLUMNS = {"items_cnt", "gross_revenue", "freight"}
PAYMENT_COLUMNS = {"payment_type", "installments", "paid_value"}
# Kept order keys are broadcast only for a limit up to this size.
MAX_BROADCAST_ORDERS = 1_000_000


def items_per_order(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("product_id").alias("items_cnt"),
        money_sum(F.col("price")).alias("gross_revenue"),
        money_sum(F.col("freight_value")).alias("freight"),
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    """First known payment type by sequence, longest instalment plan, amount paid."""
    first_known = F.min(
        F.when(
            F.col("payment_type").isNotNull(), F.struct("payment_sequential", "payment_type")
        )
    )
    return payments.groupBy("order_id").agg(
        first_known.getField("payment_type").alias("payment_type"),
        F.max("payment_installments").alias("installments"),
        money_sum(F.col("payment_value")).alias("paid_value"),
    )


def reviews_per_order(reviews: DataFrame, mode: str, order: str | None = None) -> DataFrame:
    """One review row per order: the mean score, or the latest by ``order``."""
    grouped = reviews.groupBy("order_id")
    if mode == "mean":
        return grouped.agg(F.avg("review_score").alias("review_score"))
    if mode == "latest" and order:
        return grouped.agg(F.max_by("review_score", order).alias("review_score"))
    raise ValueError("review_mode is 'fanout', 'mean', or 'latest' with review_order")


def build_facts(
    src: Sources,
    columns: Collection[str] | None = None,
    year: int | None = None,
    max_orders: int | None = None,
    review_mode: str = "fanout",
    review_order: str | None = None,
) -> DataFrame:
    """One row per order and review (an order without review gives one row).

    ``columns`` names the fact columns wanted; a source that only feeds others
    is not read.  Reviews always join in ``fanout`` mode, since they set the
    number of rows.  ``max_orders`` keeps the newest orders before any join and
    reduces the other sources to those orders first.

    Customers join first, while the rows are narrow; then everything else joins
    on the order, so one exchange of the orders serves all of those joins.  Sources in
    buckets of the order join in place instead, and customers come last.
    """
    wanted = set(FACT_COLUMNS if columns is None else columns)
    unknown = wanted - set(FACT_COLUMNS)
    if unknown:
        raise ValueError(f"not fact columns: {sorted(unknown)}")
    orders = newest(in_year(src.orders.select(*ORDER_COLUMNS), year), max_orders)

    def reduced(df: DataFrame) -> DataFrame:
        if max_orders is None:
            return df
        kept = orders.select("order_id")
        return df.join(
            F.broadcast(kept) if max_orders <= MAX_BROADCAST_ORDERS else kept,
            "order_id", "left_semi",
        )

    def with_customers(df: DataFrame) -> DataFrame:
        if "customer_state" not in wanted:
            return df
        return df.join(src.customers.select("customer_id", "customer_state"), "customer_id", "left")

    df = orders if src.bucketed else with_customers(orders)
    if wanted & ITEM_COLUMNS:
        df = df.join(items_per_order(reduced(src.items)), "order_id", "left")
    if wanted & PAYMENT_COLUMNS:
        df = df.join(payments_per_order(reduced(src.payments)), "order_id", "left")
    reviews = src.reviews.select("order_id", "review_score")
    if review_mode == "fanout":
        df = left_join_apart(df, reduced(reviews), "order_id", src.hot_orders("reviews"))
    elif "review_score" in wanted:
        ordered = src.reviews if review_order else reviews
        df = df.join(reviews_per_order(reduced(ordered), review_mode, review_order), "order_id", "left")
    if src.bucketed:
        df = with_customers(df)
    return _derive(df).select(*(c for c in FACT_COLUMNS if c in wanted))


def _derive(df: DataFrame) -> DataFrame:
    """Columns computed from the joined row, and the fills of the fact contract."""
    bought = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    fills = {
        "gross_revenue": F.lit(0.0),
        "paid_value": F.lit(0.0),
        "installments": F.lit(1),
        "payment_type": F.lit("unknown"),
        "customer_state": F.lit("NA"),
        "order_status": F.lit("unknown"),
    }
    return df.withColumns(
        {
            "purchase_dt": bought,
            "purchase_date": F.to_date(bought),
            "ym": year_month(bought),
            "on_time": on_time(delivered, promised),
            "delivery_time_h": hours_between(bought, delivered),
            "delay_h": overdue_hours(promised, delivered),
            **{c: F.coalesce(c, v) for c, v in fills.items() if c in df.columns},
        }
    )
