"""What-if estimates.  Every result is a DataFrame, one row per scenario.

All figures a scenario needs come from one aggregation of the facts
(``base_metrics``); scenarios are then projections on that single row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybill.functions.casts import ratio
from waybill.functions.money import money_sum, money_sum_where
from waybill.operators.columns import ensure_columns

# The parameters' defaults, in percent and percentage points.
DEFAULTS = {
    "margin_pct": 55.0,
    "late_cut_pp": 5.0,
    "winback_coverage_pct": 20.0,
    "winback_uplift_pct": 10.0,
    "cross_coverage_pct": 20.0,
    "cross_uplift_pct": 5.0,
}
# Fixed value: share of the late orders' revenue taken to be at stake.
REVENUE_AT_STAKE = 0.10

Get = Callable[[str], Column]


def base_metrics(facts: DataFrame, customer: str = "customer_id") -> DataFrame:
    """One row: orders, revenue, order value, late rate and the at-risk customers.

    At risk are the customers whose number of orders is at most the lower
    quartile.  Customers are reduced to "how many customers have n orders"
    before the quartile is taken: with N orders in all, that table has fewer
    than sqrt(2 N) + 2 rows, however large N is.
    """
    per_customer = facts.groupBy(customer).agg(
        F.count("order_id").alias("n"),
        F.count(F.lit(1)).alias("rows"),
        money_sum(F.col("gross_revenue")).alias("revenue"),
        money_sum_where(~F.col("on_time"), F.col("gross_revenue")).alias("late_revenue"),
        F.count_if("on_time").alias("on_time"),
        F.count("on_time").alias("rated"),
    )
    sums, amounts = ("rows", "on_time", "rated"), ("revenue", "late_revenue")
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    totals += [money_sum(F.col(c)).alias(c) for c in amounts]
    profile = per_customer.groupBy(
        F.when(F.col(customer).isNotNull(), F.col("n")).alias("n")
    ).agg(F.count(F.lit(1)).alias("customers"), *totals)
    quartile = F.percentile("n", 0.25, F.col("customers")).over(Window.partitionBy())
    at_risk = F.col("n") <= F.col("q1")
    row = profile.withColumn("q1", quartile).agg(
        *totals,
        F.max("q1").alias("q1"),
        F.coalesce(F.sum(F.when(at_risk, F.col("customers"))), F.lit(0)).alias("at_risk_customers"),
        F.coalesce(F.sum(F.when(at_risk, F.col("n") * F.col("customers"))), F.lit(0)).alias(
            "at_risk_orders"
        ),
    )
    return row.select(
        F.col("rows").alias("orders"),
        "revenue",
        F.coalesce(ratio(F.col("revenue"), F.col("rows")), F.lit(0.0)).alias("aov"),
        (1 - ratio(F.col("on_time"), F.col("rated"))).alias("late_rate"),
        "late_revenue",
        F.col("q1").cast("double").alias("q1_orders"),
        "at_risk_customers",
        "at_risk_orders",
    )


def _late(b: Get, p: Get) -> dict[str, Column]:
    rate = F.coalesce(b("late_rate"), F.lit(0.0))
    cut = rate - F.greatest(rate - p("late_cut_pp") / 100, F.lit(0.0))
    recaptured = b("revenue") * rate * REVENUE_AT_STAKE * cut / F.greatest(rate, F.lit(1e-9))
    return {
        "late_cut": cut,
        "recaptured_revenue": recaptured,
        "late_profit": recaptured * p("margin_pct") / 100,
    }


def _winback(b: Get, p: Get) -> dict[str, Column]:
    extra = (
        b("at_risk_orders").cast("double")
        * (p("winback_coverage_pct") / 100) * (p("winback_uplift_pct") / 100)
    )
    return {
        "extra_orders": extra,
        "winback_profit": extra * b("aov") * p("margin_pct") / 100,
    }


def _cross_sell(b: Get, p: Get) -> dict[str, Column]:
    extra = b("revenue") * (p("cross_coverage_pct") / 100) * (p("cross_uplift_pct") / 100)
    return {"extra_revenue": extra, "cross_profit": extra * p("margin_pct") / 100}


def _total(b: Get, p: Get) -> dict[str, Column]:
    parts = {**_late(b, p), **_winback(b, p), **_cross_sell(b, p)}
    total = parts["late_profit"] + parts["winback_profit"] + parts["cross_profit"]
    return {**parts, "total_profit": total}


def _evaluate(base: DataFrame, formulas, params: dict[str, float]) -> DataFrame:
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown scenario parameters: {sorted(unknown)}")
    values = {**DEFAULTS, **params}
    columns = formulas(F.col, lambda name: F.lit(float(values[name])))
    return base.select(*(value.alias(name) for name, value in columns.items()))


def fewer_late(base: DataFrame, **params: float) -> DataFrame:
    """Revenue kept and profit when the late rate falls by some points."""
    return _evaluate(base, _late, params)


def win_back(base: DataFrame, **params: float) -> DataFrame:
    """Extra orders and profit from reactivating the at-risk customers."""
    return _evaluate(base, _winback, params)


def cross_sell(base: DataFrame, **params: float) -> DataFrame:
    """Extra revenue and profit from a higher order value on part of the revenue."""
    return _evaluate(base, _cross_sell, params)


def all_scenarios(base: DataFrame, **params: float) -> DataFrame:
    """The three scenarios side by side with their total profit."""
    return _evaluate(base, _total, params)


def scenario_grid(base: DataFrame, grid: DataFrame) -> DataFrame:
    """Evaluate every parameter row of ``grid`` in one job.

    Parameters that are not columns of ``grid`` take their default.  The facts
    are aggregated once, as a one-row subquery.
    """
    filled = ensure_columns(grid, {name: F.lit(value) for name, value in DEFAULTS.items()})
    known = filled.withColumn("_base", base.select(F.struct("*")).scalar())
    columns = _total(lambda name: F.col(f"_base.{name}"), F.col)
    return known.select(*filled.columns, *(value.alias(name) for name, value in columns.items()))


def late_revenue_share(facts: DataFrame, reduce_pp: float = 5.0) -> DataFrame:
    """The simple estimate: that share of the late orders' revenue is kept.
    Nothing late, or no reduction, gives 0."""
    late = money_sum_where(~F.col("on_time"), F.col("gross_revenue"))
    return facts.agg(
        (late * F.greatest(F.lit(float(reduce_pp)), F.lit(0.0)) / 100).alias("recaptured_revenue")
    )


def late_revenue_profit(
    facts: DataFrame, reduce_pp: float = 5.0, margin_pct: float = 55.0, handling_cost: float = 1.2
) -> DataFrame:
    """The simple estimate with profit.  ``handling_cost`` is accepted for the
    sake of the interface; the estimate does not use it."""
    late = money_sum_where(~F.col("on_time"), F.col("gross_revenue"))
    kept = late * F.lit(float(reduce_pp)) / 100
    return facts.agg(
        kept.alias("recaptured_revenue"), (kept * F.lit(float(margin_pct)) / 100).alias("profit")
    )


def fewer_cancellations(
    facts: DataFrame, cut_pct: float = 10.0, margin_pct: float = 55.0, status: str = "canceled"
) -> DataFrame:
    """Revenue and profit kept when part of the cancelled orders goes through."""
    lost = F.col("order_status") == status
    row = facts.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(lost).alias("lost_orders"),
        money_sum_where(lost, F.col("gross_revenue")).alias("lost_revenue"),
        money_sum(F.col("gross_revenue")).alias("revenue"),
    )
    kept = F.col("lost_revenue") * F.lit(float(cut_pct)) / 100
    return row.select(
        "orders", "lost_orders",
        ratio(F.col("lost_orders"), F.col("orders")).alias("lost_rate"),
        "lost_revenue",
        kept.alias("kept_revenue"),
        (kept * F.lit(float(margin_pct)) / 100).alias("profit"),
    )
