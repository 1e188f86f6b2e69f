"""Every registered query: (spark, folder) → DataFrame over the test tables.

Rates and means are rounded to six decimals here, so that two engines which
add floating-point numbers in different orders print the same value.  An amount
in cents times two percentages has six decimals, so it is never cut at a tie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waybill.functions.money import money_sum
from waybill.operators import classification, filters
from waybill.operators.columns import fill_measures, repair_facts, with_customer_key
from waybill.operators.skew import frequent_keys, left_join_apart
from waybill.operators.topk import newest, oldest
from waybill.plans import (
    basket, delivery, geo, payments, reports, reviews, rfm, risk, scenarios, sketches, sql_view, trends,
)
from waybill.plans.facts import build_facts
from waybill.schemas import SOURCE_SCHEMAS
from waybill.session import scratch_path
from waybill.sources import marketplace
from waybill.sources.catalogue import Catalogue, count_rows
from waybill.sources.refresh import StoredFacts
from waybill.sources.sinks import bucketed_sources, read_facts, stored_date_bounds, write_facts
from waybill.streaming.trend import follow_daily_trend, followed_trend

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered examples.
PERIOD = (date(1996, 3, 1), date(1998, 9, 15))
YEAR = 1997
NEWEST = 10_000
# From when on payments and reviews, and orders, come in a second delivery.
DELIVERIES = (datetime(2001, 7, 5), datetime(2001, 7, 20))
BASKET_SUPPORT = 0.015


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def facts_of(spark: SparkSession, folder: str, *columns: str, **options) -> DataFrame:
    return build_facts(
        marketplace.load(spark, folder), columns=("order_id", *columns) if columns else None, **options
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def placed(df: DataFrame) -> DataFrame:
    """Add the row's place in the order the report gives, so that sorts are compared.

    The reports sorted here have one row per type, score or day, so their place can be
    counted in one task.
    """
    numbered = df.withColumn("place", F.monotonically_increasing_id())
    place = (F.row_number().over(Window.orderBy("place")) - 1).cast("int")
    return numbered.select(place.alias("place"), *df.columns)


def text_time(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that the comparison does not depend on clients."""
    return df.select(
        *(
            F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        )
    )


# --- sources and facts -------------------------------------------------------


@register
def source_counts(spark, folder):
    src = marketplace.load(spark, folder)
    return count_rows({name: getattr(src, name) for name in SOURCE_SCHEMAS})


@register
def facts_table(spark, folder):
    """All facts, after frequent orders have been looked for in the reviews."""
    facts = build_facts(marketplace.load(spark, folder, look_up=True))
    return text_time(rounded(facts, "delivery_time_h", "delay_h"))


@register
def facts_one_row_per_order(spark, folder):
    facts = facts_of(
        spark, folder, "gross_revenue", "paid_value", "review_score", review_mode="mean"
    )
    return rounded(facts, "review_score")


@register
def facts_of_year(spark, folder):
    return facts_of(
        spark, folder, "ym", "purchase_date", "items_cnt", "gross_revenue", "freight", year=YEAR
    )


@register
def facts_newest(spark, folder):
    return facts_of(
        spark, folder, "purchase_date", "gross_revenue", "payment_type", "review_score",
        "customer_state", max_orders=NEWEST,
    )


@register
def facts_repaired(spark, folder):
    """Facts from a producer that delivers only the bare order columns."""
    bare = facts_of(
        spark, folder, "customer_id", "order_purchase_timestamp", "gross_revenue"
    ).withColumn("customer_id", F.lit(None).cast("bigint"))
    full = with_customer_key(repair_facts(bare))
    filled = fill_measures(full, "delivery_time_h", "delay_h")
    return filled.groupBy("ym", "payment_type", "customer_state", "installments").agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count_if(F.col("on_time").isNull()).alias("unrated"),
        F.sum("delay_h").alias("delay_h"),
        trends.revenue(),
    )


@register
def facts_from_sink(spark, folder):
    """A period of facts, read back from the table partitioned by month."""
    path = scratch_path(spark, "facts")
    facts = facts_of(
        spark, folder, "purchase_dt", "purchase_date", "ym", "gross_revenue", "on_time"
    )
    write_facts(facts, path)
    stored = read_facts(spark, path, facts.schema)
    return rounded(trends.kpis(filters.in_period(stored, *PERIOD)), "aov", "on_time_rate")


@register
def facts_bucketed(spark, folder):
    """All facts from sources in buckets of the order, joined without an exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = build_facts(bucketed_sources(marketplace.load(spark, folder), buckets))
    return text_time(rounded(facts, "delivery_time_h", "delay_h"))


@register
def facts_refreshed(spark, folder):
    """All facts from a stored table that late files of all sources have brought up to date.

    Reviews and payments of the last purchases arrive in a second delivery, as do the
    orders of the last days; only the months they touch are rebuilt.
    """
    root = scratch_path(spark, "deliveries")
    src = marketplace.load(spark, folder)
    late = src.orders.select("order_id", (F.col("order_purchase_timestamp") >= F.lit(DELIVERIES[0])).alias("late"))
    stored = StoredFacts(
        spark, root, f"{root}/facts", {name: getattr(src, name).schema for name in SOURCE_SCHEMAS}
    )
    for second in (False, True):
        for name in SOURCE_SCHEMAS:
            rows = getattr(src, name)
            if name == "orders":
                rows = rows.filter((F.col("order_purchase_timestamp") >= F.lit(DELIVERIES[1])) == second)
            elif name in ("payments", "reviews"):
                rows = rows.join(late.filter(F.col("late") == second), "order_id", "left_semi")
            elif second:
                continue
            rows.write.mode("append").parquet(f"{root}/{name}")
        stored.refresh()
    return text_time(rounded(stored.read(), "delivery_time_h", "delay_h"))


@register
def orders_from_csv(spark, folder):
    """Orders written as CSV, found by the catalogue, converted once to Parquet."""
    root = scratch_path(spark, "csv")
    marketplace.load(spark, folder).orders.write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(f"{root}/orders.csv")
    catalogue = Catalogue(spark, root)
    catalogue.materialise_all()
    orders = catalogue.read("orders")
    return orders.groupBy(F.year("order_purchase_timestamp").alias("year"), "order_status").agg(
        F.count("order_id").alias("orders"),
        F.count("order_delivered_customer_date").alias("delivered"),
    )


@register
def newest_orders(spark, folder):
    orders = newest(marketplace.load(spark, folder).orders, NEWEST)
    return text_time(orders.select("order_id", "order_status", "order_purchase_timestamp"))


@register
def oldest_delivered_orders(spark, folder):
    delivered = filters.with_status(marketplace.load(spark, folder).orders, "delivered")
    return text_time(oldest(delivered, NEWEST).select("order_id", "order_purchase_timestamp"))


@register
def discount_totals(spark, folder):
    """Amounts with many decimals, not-a-number and missing amounts among them."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    discount = F.col("l_extendedprice") * F.col("l_discount")
    amount = F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 13 != 0, discount)
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        money_sum(discount).alias("discount"), money_sum(amount).alias("known"),
        money_sum(discount / 100).alias("fine"),
    )


@register
def absent_sources(spark, folder):
    """Orders from a file, reviews and older orders from files that are not there."""
    root = scratch_path(spark, "absent")
    marketplace.load(spark, folder).orders.write.parquet(f"{root}/orders.parquet")
    here = Catalogue(spark, root)
    nowhere = Catalogue(spark, root, files={"orders": "orders_of_old"})
    orders = here.read("orders").unionByName(nowhere.read("orders"))
    joined = orders.join(here.read("reviews"), "order_id", "left")
    return joined.groupBy(F.year("order_purchase_timestamp").alias("year"), "order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.count("review_score").alias("reviews"),
        F.count("order_id").alias("keys"),
    )


@register
def hot_order_reviews(spark, folder):
    """Every third review belongs to one order, the orders they came from have none; the
    key of that order is dealt over several tasks."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_custkey"
    )
    reviews = orders.select(
        F.when(F.col("order_id") % 3 == 0, 1).otherwise(F.col("order_id")).cast("bigint").alias("order_id"),
        (1 + F.col("order_id") * 31 % 5).alias("score"),
    )
    # A fifth of all rows is too much for a task, whatever the number of partitions.
    fifth = 0.2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent_keys(reviews, "order_id", tasks=fifth, rows=50)
    joined = left_join_apart(orders, reviews, "order_id", hot)
    return joined.groupBy("status", (F.col("o_custkey") % 10).alias("ring")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("score").alias("reviews"), F.sum("score").alias("score"),
        F.lit(len(hot)).cast("long").alias("hot_keys"),
    )


@register
def date_bounds(spark, folder):
    return filters.date_bounds(facts_of(spark, folder, "purchase_date"))


@register
def date_bounds_stored(spark, folder):
    """The same of a stored fact table, from the statistics in its files."""
    path = scratch_path(spark, "facts")
    facts = facts_of(spark, folder, "ym", "purchase_date")
    write_facts(facts, path)
    return stored_date_bounds(spark, path, facts.schema)


# --- sales -------------------------------------------------------------------


@register
def home_metrics(spark, folder):
    return rounded(
        trends.home_metrics(facts_of(spark, folder, "on_time", "gross_revenue")), "on_time_pct"
    )


def _summaries(spark, folder, facts: DataFrame, make, columns: str) -> DataFrame:
    """Summaries written by month and read back."""
    path = scratch_path(spark, "summaries")
    sketches.write_summaries(make(facts), path)
    return sketches.read_summaries(spark, path, columns)


@register
def period_metrics_stored(spark, folder):
    """Home figures per state of a period from stored summaries, beside the exact count."""
    facts = facts_of(spark, folder, "purchase_dt", "purchase_date", "ym", "customer_state", "on_time", "gross_revenue")
    days = _summaries(spark, folder, facts, sketches.day_summaries, sketches.DAY_COLUMNS)
    found = sketches.metrics(sketches.in_days(days, *PERIOD), ["customer_state"]).withColumnRenamed("orders", "estimate")
    exact = filters.in_period(facts, *PERIOD).groupBy("customer_state").agg(F.count_distinct("order_id").alias("orders"))
    off = F.abs(F.col("estimate") - F.col("orders"))
    return rounded(found, "on_time_pct").join(exact, "customer_state").select(
        "customer_state", "orders", "on_time_pct", "revenue",
        (off <= sketches.distinct_bound() * F.col("orders")).alias("within_bound"),
    )


def _rank_is_near(facts: DataFrame, box: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per score whether each estimated quantile has a rank within the bound."""
    x, bound = F.col("delivery_time_h"), F.lit(sketches.rank_bound())
    joined = facts.join(F.broadcast(box), "review_score")  # one row per score
    counts = joined.groupBy("review_score", "n").agg(
        *(F.count_if(x < F.col(q)).alias(f"{q}_below") for q in shares), *(F.count_if(x <= F.col(q)).alias(f"{q}_upto") for q in shares)
    )
    near = (
        ((F.col(f"{q}_below") / F.col("n") <= share + bound) & (F.col(f"{q}_upto") / F.col("n") >= share - bound)).alias(f"{q}_near")
        for q, share in shares.items()
    )
    return counts.select("review_score", F.col("n").alias("orders"), *near)


@register
def delivery_box_stored(spark, folder):
    """Quartiles of the delivery hours per score from stored monthly sketches, their ranks checked."""
    facts = facts_of(spark, folder, "ym", "review_score", "delivery_time_h").filter("review_score IS NOT NULL")
    hours = _summaries(spark, folder, facts, sketches.hour_summaries, sketches.HOUR_COLUMNS)
    known = facts.filter("delivery_time_h IS NOT NULL")
    return _rank_is_near(known, sketches.hours_box(hours), {"q1": 0.25, "median": 0.5, "q3": 0.75})


@register
def delivery_histogram_stored(spark, folder):
    """Orders by days of delivery time from stored monthly sketches, beside the exact counts."""
    facts = facts_of(spark, folder, "ym", "review_score", "delivery_time_h")
    hours = _summaries(spark, folder, facts, sketches.hour_summaries, sketches.HOUR_COLUMNS)
    found = sketches.hours_histogram(hours, 24.0, 40).withColumnRenamed("rows", "estimate")
    known = facts.filter("delivery_time_h IS NOT NULL")
    exact = known.groupBy(F.floor(F.col("delivery_time_h") / 24).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    bound = 2 * sketches.rank_bound() * known.count()
    rows = F.coalesce("rows", F.lit(0))
    return found.join(exact, "bin", "left").select(
        "bin", rows.alias("rows"), (F.abs(F.col("estimate") - rows) <= F.lit(bound) + 1).alias("within_bound")
    )


@register
def kpis(spark, folder):
    return rounded(
        trends.kpis(facts_of(spark, folder, "gross_revenue", "on_time")), "aov", "on_time_rate"
    )


@register
def kpis_of_period(spark, folder):
    facts = facts_of(spark, folder, "gross_revenue", "on_time", "purchase_dt", "ym")
    return rounded(trends.kpis(filters.in_period(facts, *PERIOD)), "aov", "on_time_rate")


@register
def kpis_last_year(spark, folder):
    facts = facts_of(spark, folder, "gross_revenue", "on_time", "purchase_dt")
    return rounded(trends.kpis(filters.last_year_only(facts)), "aov", "on_time_rate")


@register
def daily_trend_ma(spark, folder):
    return rounded(
        trends.daily_trend(facts_of(spark, folder, "purchase_date", "gross_revenue")),
        "orders_ma", "revenue_ma", digits=4,
    )


@register
def daily_trend_followed(spark, folder):
    """The daily trend over three deliveries of facts, each with rows of all times."""
    root = scratch_path(spark, "arriving")
    facts = facts_of(spark, folder, "purchase_dt", "purchase_date", "gross_revenue")
    facts.repartition(3, "order_id").write.parquet(f"{root}/facts")
    followed = follow_daily_trend(
        spark, f"{root}/facts", f"{root}/trend", facts.schema, f"trend_{uuid.uuid4().hex}", lateness="40 years", files_per_batch=1
    )
    followed.awaitTermination()
    return rounded(followed_trend(spark, f"{root}/trend"), "orders_ma", "revenue_ma", digits=4)


@register
def daily_trend_ma30(spark, folder):
    return rounded(
        trends.daily_trend(facts_of(spark, folder, "purchase_date", "gross_revenue"), 30),
        "orders_ma", "revenue_ma", digits=4,
    )


@register
def monthly_trend(spark, folder):
    return rounded(trends.monthly_trend(facts_of(spark, folder, "ym", "gross_revenue")), "aov")


@register
def dow_hour_heatmap(spark, folder):
    return trends.busy_hours(facts_of(spark, folder, "purchase_dt"))


@register
def dow_hour_grid(spark, folder):
    grid = trends.busy_hours_grid(facts_of(spark, folder, "purchase_dt"))
    return grid.select(
        "dow_index", "dow", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24))
    )


# --- delivery ----------------------------------------------------------------


@register
def sla_kpis(spark, folder):
    facts = facts_of(spark, folder, "on_time", "delivery_time_h", "delay_h")
    return rounded(delivery.sla_kpis(facts), "on_time_rate", "avg_delivery_h", "avg_delay_h")


@register
def sla_kpis_delivered(spark, folder):
    facts = facts_of(spark, folder, "on_time", "delivery_time_h", "delay_h")
    return rounded(
        delivery.sla_kpis(facts, delivered_only=True), "on_time_rate", "avg_delivery_h", "avg_delay_h"
    )


@register
def sla_daily(spark, folder):
    return rounded(
        delivery.sla_daily(facts_of(spark, folder, "purchase_date", "on_time")), "on_time_rate"
    )


@register
def delivery_histogram(spark, folder):
    return rounded(
        delivery.delivery_histogram(facts_of(spark, folder, "delivery_time_h")), "bin_start", "bin_end"
    )


@register
def delay_histogram(spark, folder):
    return rounded(
        delivery.delay_histogram(facts_of(spark, folder, "delay_h")), "bin_start", "bin_end"
    )


@register
def whatif_late_simple(spark, folder):
    return rounded(
        scenarios.late_revenue_share(facts_of(spark, folder, "on_time", "gross_revenue")),
        "recaptured_revenue",
    )


@register
def stage_times(spark, folder):
    facts = facts_of(
        spark, folder, "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date",
    )
    return rounded(
        delivery.stage_times(facts), "approval_h", "processing_h", "shipping_h", "delivery_h"
    )


# --- payments ----------------------------------------------------------------


@register
def payments_kpis(spark, folder):
    return rounded(trends.sales_totals(facts_of(spark, folder, "gross_revenue")), "aov")


@register
def payments_by_type(spark, folder):
    facts = facts_of(spark, folder, "payment_type", "installments", "gross_revenue")
    return placed(rounded(payments.by_type(facts), "installments_avg", "aov", "share_pct"))


@register
def payments_breakdown(spark, folder):
    facts = facts_of(spark, folder, "payment_type", "gross_revenue")
    return rounded(payments.breakdown(facts), "aov", "share_pct")


@register
def payments_by_installments(spark, folder):
    facts = facts_of(spark, folder, "installments", "gross_revenue")
    return rounded(payments.by_installments(facts), "aov", "share_pct")


@register
def payments_value_by_installments(spark, folder):
    facts = facts_of(spark, folder, "installments", "gross_revenue")
    return placed(rounded(payments.by_installments_value(facts), "aov", "share_pct"))


@register
def payments_presented(spark, folder):
    facts = facts_of(spark, folder, "payment_type", "installments", "gross_revenue")
    return payments.present_by_type(payments.by_type(facts))


# --- reviews -----------------------------------------------------------------


@register
def reviews_kpis(spark, folder):
    facts = facts_of(spark, folder, "review_score", "on_time", "delay_h")
    return rounded(reviews.review_kpis(facts), "avg_score", "on_time_rate", "avg_delay_h")


@register
def review_distribution(spark, folder):
    return rounded(reviews.distribution(facts_of(spark, folder, "review_score")), "share_pct")


@register
def reviews_by_score(spark, folder):
    facts = facts_of(spark, folder, "review_score", "on_time", "delivery_time_h", "delay_h")
    return rounded(reviews.by_score(facts), "on_time_rate", "delivery_time_h", "delay_h")


@register
def delivery_box_by_score(spark, folder):
    facts = facts_of(spark, folder, "review_score", "delivery_time_h")
    return rounded(
        reviews.delivery_box(facts),
        "min_value", "q1", "median", "q3", "max_value", "lower_fence", "upper_fence",
    )


@register
def promoter_score(spark, folder):
    return rounded(reviews.promoter_score(facts_of(spark, folder, "review_score")), "nps")


# --- customers ---------------------------------------------------------------


def _customer_facts(spark, folder):
    return facts_of(spark, folder, "customer_id", "purchase_dt", "gross_revenue")


@register
def rfm_scores(spark, folder):
    return rfm.rfm_scores(_customer_facts(spark, folder))


@register
def rfm_segments(spark, folder):
    return rounded(
        rfm.segment_summary(rfm.rfm_scores(_customer_facts(spark, folder))),
        "avg_monetary", "share_customers_pct",
    )


@register
def rfm_totals(spark, folder):
    return rfm.rfm_totals(rfm.rfm_base(_customer_facts(spark, folder)))


@register
def rfm_top_customers(spark, folder):
    return rfm.top_customers(rfm.rfm_scores(_customer_facts(spark, folder)))


@register
def rfm_sum_histogram(spark, folder):
    return rounded(
        rfm.rfm_sum_histogram(rfm.rfm_scores(_customer_facts(spark, folder))), "bin_start", "bin_end"
    )


# --- scenarios ---------------------------------------------------------------


def _base(spark, folder):
    return scenarios.base_metrics(facts_of(spark, folder, "customer_id", "gross_revenue", "on_time"))


@register
def roi_base(spark, folder):
    return rounded(_base(spark, folder), "aov", "late_rate", "q1_orders")


@register
def roi_late(spark, folder):
    return rounded(
        scenarios.fewer_late(_base(spark, folder)), "late_cut", "recaptured_revenue", "late_profit",
        digits=4,
    )


@register
def roi_agent_late(spark, folder):
    facts = facts_of(spark, folder, "on_time", "gross_revenue")
    return rounded(
        scenarios.late_revenue_profit(facts), "recaptured_revenue", "profit"
    )


@register
def roi_winback(spark, folder):
    return rounded(
        scenarios.win_back(_base(spark, folder)), "extra_orders", "winback_profit", digits=4
    )


@register
def roi_cross_sell(spark, folder):
    return rounded(
        scenarios.cross_sell(_base(spark, folder)), "extra_revenue", "cross_profit"
    )


@register
def roi_total(spark, folder):
    total = scenarios.all_scenarios(_base(spark, folder))
    return rounded(total, *total.columns)


@register
def roi_grid(spark, folder):
    steps = spark.sql(
        """
        SELECT margin_pct, late_cut_pp, explode(array(0D, 20D, 80D)) AS winback_coverage_pct
        FROM (SELECT margin_pct, explode(array(0D, 5D, 20D)) AS late_cut_pp
              FROM (SELECT explode(array(30D, 55D, 80D)) AS margin_pct))
        """
    )
    grid = scenarios.scenario_grid(_base(spark, folder), steps).select(
        *steps.columns, "late_profit", "winback_profit", "cross_profit", "total_profit"
    )
    return rounded(grid, "late_profit", "winback_profit", "cross_profit", "total_profit")


@register
def roi_cancellations(spark, folder):
    """The test tables cancel nothing; open orders stand in for cancelled ones."""
    facts = facts_of(spark, folder, "order_status", "gross_revenue")
    return rounded(
        scenarios.fewer_cancellations(facts, status="shipped"), "lost_rate", "kept_revenue", "profit"
    )


# --- states ------------------------------------------------------------------


def _geo(spark, folder):
    return facts_of(spark, folder, "customer_state", "on_time", "delivery_time_h", "delay_h")


@register
def geo_customer_state(spark, folder):
    return rounded(
        geo.by_state(_geo(spark, folder)), "on_time_rate", "avg_delivery_days", "avg_delay_days"
    )


@register
def geo_seller_state(spark, folder):
    src = marketplace.load(spark, folder)
    facts = geo.with_seller_state(
        facts_of(spark, folder, "on_time", "delivery_time_h", "delay_h"), src
    )
    return rounded(
        geo.by_state(facts, "seller_state"), "on_time_rate", "avg_delivery_days", "avg_delay_days"
    )


@register
def geo_overall(spark, folder):
    return rounded(
        geo.overall(geo.by_state(_geo(spark, folder))), "on_time_rate", "avg_delivery_days"
    )


@register
def geo_presented(spark, folder):
    shown = geo.present_states(geo.by_state(_geo(spark, folder)))
    return rounded(shown, "avg_delivery_days", "avg_delay_days")


@register
def order_seller_state(spark, folder):
    return geo.order_seller_state(marketplace.load(spark, folder))


# --- late-delivery risk ------------------------------------------------------


def _training(spark, folder, keep_keys=False):
    return risk.training_table(marketplace.load(spark, folder), keep_keys=keep_keys)


def _plain_score() -> Column:
    """A score in whole hundredths with many ties, for checking the quality measures."""
    return ((24 - F.col("hour")) * 4 + F.col("items_cnt") % 4) / F.lit(100.0)


@register
def risk_training_table(spark, folder):
    return rounded(
        _training(spark, folder, keep_keys=True),
        "promised_days", "freight_value", "total_weight_kg", "total_volume_dm3",
    )


@register
def risk_oldest_training_table(spark, folder):
    table = risk.training_table(marketplace.load(spark, folder), max_orders=NEWEST)
    return table.groupBy("seller_state", "late").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("same_state").alias("same_state"),
        F.sum("items_cnt").alias("items"),
    )


@register
def risk_one_row_per_order(spark, folder):
    table = risk.training_table(marketplace.load(spark, folder), payment_mode="first")
    return table.groupBy("payment_type", "payment_installments", "late").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("hour").alias("hours")
    )


@register
def risk_class_weights(spark, folder):
    return rounded(classification.class_weights(_training(spark, folder)), "weight")


@register
def risk_split_sizes(spark, folder):
    parts = risk.split(_training(spark, folder, keep_keys=True))
    return parts.groupBy("late", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@register
def risk_split_drawn(spark, folder):
    """Sizes of a split drawn row by row in one pass, and whether each class's part is
    within five deviations of its share."""
    parts = classification.drawn_split(_training(spark, folder, keep_keys=True), risk.KEYS, test_share=DRAWN_SHARES)
    shares = F.create_map(*(F.lit(x) for pair in DRAWN_SHARES.items() for x in pair))
    share = shares[F.col("late")]
    sizes = parts.groupBy("late").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))
    off = F.abs(F.col("test_rows") - F.col("rows") * share)
    return sizes.withColumn("near_share", off <= 5 * F.sqrt(F.col("rows") * share * (1 - share)) + 1)


@register
def risk_split_rows(spark, folder):
    """Which rows are drawn for the test part."""
    parts = risk.split(_training(spark, folder, keep_keys=True))
    return parts.select(*risk.KEYS, "late", "is_test")


@register
def risk_summary(spark, folder):
    parts = risk.split(_training(spark, folder, keep_keys=True))
    return rounded(risk.test_summary(parts.filter("is_test")), "late_pct")


# Shares of a drawn split per class.
DRAWN_SHARES = {0: 0.2, 1: 0.3}
# Weights as a fit might give them, for checking scores and rankings.
FIXED_WEIGHTS = {
    "weekday": 0.05, "hour": -0.02, "promised_days": -0.11, "items_cnt": 0.2, "freight_value": 0.0004,
    "total_weight_kg": 0.01, "same_state": -0.3, "payment_type=boleto": 0.4, "payment_type=voucher": -0.2,
    "payment_type=__null__": 0.7, "customer_state=SP": -0.25, "customer_state=__null__": 0.11, "seller_state=RJ": 0.25,
}


def _fixed_scores(spark, folder):
    """Every seventh order lacks its promised days."""
    table = _training(spark, folder, keep_keys=True)
    gaps = F.when(F.col("order_id") % 7 != 0, F.col("promised_days"))
    return risk.scored_by(table.withColumn("promised_days", gaps), FIXED_WEIGHTS, 2.0)


@register
def risk_scores(spark, folder):
    return rounded(_fixed_scores(spark, folder).select(*risk.KEYS, "payment_type", "risk"), "risk")


@register
def risk_fixed_quality(spark, folder):
    scored = _fixed_scores(spark, folder).filter("risk IS NOT NULL")
    return rounded(risk.quality(scored.withColumn("risk", F.round("risk", 4))), "auc")


@register
def risk_fixed_top(spark, folder):
    """Weights by size, of those categories that occur."""
    table = _training(spark, folder)
    there = None
    for name in risk.CATEGORICAL:
        value = F.concat(F.lit(f"{name}="), F.coalesce(name, F.lit(risk.MISSING)))
        part = table.select(value.alias("feature")).distinct()
        there = part if there is None else there.unionByName(part)
    there = there.unionByName(spark.createDataFrame([(n,) for n in risk.NUMERIC], "feature string"))
    weights = spark.createDataFrame(list(FIXED_WEIGHTS.items()), "feature string, coef double")
    return risk.top_weights(weights.join(there, "feature"), 8)


@register
def risk_encoding(spark, folder):
    """Rows with a non-zero value per encoded feature; vouchers were never seen."""
    table = _training(spark, folder)
    encoder = risk.fit_encoder(table.filter("payment_type <> 'voucher' OR payment_type IS NULL"))
    names = F.array(*map(F.lit, risk.feature_names(encoder)))
    values = risk.encode(encoder, table).select(F.posexplode(vector_to_array("features")).alias("k", "v"))
    return values.groupBy(F.get(names, F.col("k")).alias("feature")).agg(F.count_if(F.col("v") != 0).alias("rows"))


@register
def risk_slopes(spark, folder):
    """The fitted model stands at the bottom of its loss: all slopes are nil."""
    train = risk.split(_training(spark, folder, keep_keys=True)).filter(~F.col("is_test"))
    slopes = risk.loss_gradient(risk.fit(train), train)
    return slopes.select("feature", F.abs(F.round("slope", 2)).alias("slope"))


@register
def risk_confusion(spark, folder):
    scored = _training(spark, folder).withColumn("score", _plain_score())
    return classification.confusion_matrix(
        scored.withColumn("predicted", classification.predict_class(F.col("score"), 0.5)),
        "late", "predicted",
    )


@register
def risk_auc(spark, folder):
    scored = _training(spark, folder).withColumn("score", _plain_score())
    return rounded(classification.roc_auc(scored, "late", "score"), "auc")


@register
def risk_top_features(spark, folder):
    parts = risk.split(_training(spark, folder, keep_keys=True))
    model = risk.fit(parts.filter(~F.col("is_test")))
    return model.top_features(spark)


@register
def risk_model_quality(spark, folder):
    parts = risk.split(_training(spark, folder, keep_keys=True))
    model = risk.fit(parts.filter(~F.col("is_test")))
    return risk.quality(model.score(parts.filter("is_test")))


# --- SQL, reports, texts, baskets --------------------------------------------


@register
def sql_top_payments(spark, folder):
    facts = facts_of(spark, folder, "payment_type", "gross_revenue")
    return sql_view.query(sql_view.TOP_PAYMENT_TYPES, facts=facts)


@register
def sql_worst_states(spark, folder):
    facts = facts_of(spark, folder, "customer_state", "on_time")
    return rounded(sql_view.query(sql_view.WORST_STATES, facts=facts), "on_time_rate")


@register
def sql_monthly(spark, folder):
    facts = facts_of(spark, folder, "order_purchase_timestamp", "gross_revenue")
    return sql_view.query(sql_view.MONTHLY_SALES, facts=facts)


@register
def sql_free_query(spark, folder):
    """Set operations, grouping sets and a window, as a user may write them."""
    facts = facts_of(spark, folder, "customer_state", "order_status", "gross_revenue", "on_time")
    return sql_view.query(
        """
        SELECT customer_state, order_status, orders,
               RANK() OVER (PARTITION BY order_status ORDER BY orders DESC) AS place
        FROM (SELECT customer_state, order_status, COUNT(*) AS orders FROM facts
              GROUP BY ROLLUP (customer_state, order_status))
        WHERE customer_state IN (SELECT customer_state FROM facts WHERE on_time
                                 EXCEPT SELECT customer_state FROM facts WHERE customer_state = 'NA')
        """,
        facts=facts,
    )


@register
def report_by_name(spark, folder):
    facts = facts_of(spark, folder, "review_score", "on_time", "delivery_time_h", "delay_h")
    return rounded(
        reviews.present_by_score(reports.run_report("reviews_summary", facts)).drop("on_time_pct"),
        "delivery_time_h", "delay_h",
    )


@register
def report_rfm(spark, folder):
    return reports.run_report("rfm", _customer_facts(spark, folder))


# Stems that occur in the test conversations, for every report one.
STEMS = [
    ("trend", ["äch", "üch"]), ("payments_breakdown", ["queque"]), ("reviews_summary", ["menteaux", "oiñ"]),
    ("rfm", ["schau"]), ("roi_reduce_late", ["THEA", "ñó"]), ("kpis", ["zzz"]),
]


@register
def text_routing(spark, folder):
    """Texts with the stems of the test tables' invented words, in either case."""
    talks = spark.read.parquet(f"{folder}/conversations.parquet")
    stems = [(route, [stem.lower() for stem in own]) for route, own in STEMS]
    shouted = talks.withColumn("text", F.when(F.col("turn") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    return reports.tag_text(shouted, routes=stems).select("conv_id", "turn", "route")


@register
def text_routing_words(spark, folder):
    """The built-in stems, appended to the whole texts."""
    talks = spark.read.parquet(f"{folder}/conversations.parquet")
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("conv_id") % len(ASKED)).cast("int") + 1)
    texts = talks.withColumn("text", F.concat_ws(" ", "text", asked))
    return reports.tag_text(texts).select("conv_id", "turn", "route")


ASKED = [
    "KPI за рік", "Динаміка продажів", "time series please", "Скільки Оплат", "installments", "Відгуки", "NPS now",
    "RFM", "сегменти", "Late deliveries", "простроченi", "nothing at all",
]


@register
def report_names(spark, folder):
    """All six reports by name: the columns and the rows of each."""
    facts = facts_of(
        spark, folder, "customer_id", "purchase_dt", "purchase_date", "gross_revenue", "on_time", "payment_type",
        "review_score", "delivery_time_h", "delay_h",
    )
    parts = [
        reports.run_report(name, facts).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows")
        for name in reports.REPORTS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register
def basket_triples(spark, folder):
    """Rules of three part types bought together."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    types = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.col("p_type").alias("item"))
    bought = lines.join(types, F.col("l_partkey") == F.col("p_partkey")).select("basket", "item")
    rules = basket.mine(bought, 0.05, max_length=3).rules()
    return rounded(rules.filter(F.col("antecedent").contains(" + ")), "support", "confidence", "lift")


def _rules(spark, folder):
    return basket.mine(marketplace.baskets(spark, folder), BASKET_SUPPORT)


@register
def basket_pairs(spark, folder):
    return _rules(spark, folder).pairs()


@register
def basket_rules(spark, folder):
    return rounded(_rules(spark, folder).rules(), "support", "confidence", "lift")
