"""Recency, frequency and monetary value per customer, scores and segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from waybill.functions.money import money_sum
from waybill.functions.timing import whole_days_between
from waybill.operators.cuts import cuts
from waybill.operators.distribution import histogram
from waybill.operators.ranks import fifth_edges
from waybill.operators.sharing import with_share
from waybill.operators.topk import top

MEASURES = ("recency", "frequency", "monetary")
NEUTRAL_SCORE = 3

# Segments with the score ranges (both ends included) that make
# them, in the order in which they are tried; any score not named may be anything.
SEGMENTS = {
    "Champions": {"r": (4, 5), "f": (4, 5), "m": (4, 5)},
    "Loyal": {"r": (4, 5), "f": (3, 5)},
    "At Risk": {"r": (1, 2), "f": (3, 5)},
    "Hibernating": {"r": (1, 2), "f": (1, 2), "m": (1, 2)},
    "New": {"r": (4, 5), "f": (1, 2)},
}
OTHER_SEGMENT = "Others"


def rfm_base(facts: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Days since the last purchase, number of orders and revenue per customer.

    Days are whole 24-hour periods before one day after the last purchase of
    all.  ``customer`` names the key column.
    """
    snapshot = facts.agg(F.max("purchase_dt") + F.expr("interval 1 day")).scalar()
    return (
        facts.filter(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"))
        .agg(
            F.max("purchase_dt").alias("last_dt"),
            F.count("order_id").alias("frequency"),
            money_sum(F.col("gross_revenue")).alias("monetary"),
        )
        .select(
            "customer_id",
            whole_days_between(F.col("last_dt"), snapshot).alias("recency"),
            "frequency",
            "monetary",
        )
    )


def segment(scores: Mapping[str, Column]) -> Column:
    """Segment of a score triple, given as columns for ``r``, ``f`` and ``m``."""
    name = F.lit(OTHER_SEGMENT)
    for label, ranges in reversed(SEGMENTS.items()):
        fits = F.lit(True)
        for score, (low, high) in ranges.items():
            fits &= scores[score].between(low, high)
        name = F.when(fits, label).otherwise(name)
    return name


def rfm_scores(facts: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The base figures with scores 1..5, their sum and the segment.

    A score is the fifth a customer falls in when all are ordered by the measure
    (ties by customer), recent buyers getting the high score.  Where fifths do
    not exist (a single customer, or a missing value) everyone scores 3.

    Only the rows at the four edges between the fifths are sought, for all measures
    together, by counting; then every customer is compared with them.
    """
    base = rfm_base(facts, customer)
    held = base.persist(StorageLevel.MEMORY_AND_DISK)  # read by every count
    try:
        missing = held.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in MEASURES)).first()
        long = held.select(
            "customer_id", *(F.col(c).cast("double").alias(c) for c in MEASURES)
        ).unpivot("customer_id", list(MEASURES), "measure", "value")
        edges = cuts(long, ["value", "customer_id"], fifth_edges, group=["measure"])
    finally:
        held.unpersist()
    scored = base
    for name, measure in zip(("r", "f", "m"), MEASURES, strict=True):
        n, found = edges.get((measure,), (0, {}))
        if missing[measure] or n < 2:
            score = F.lit(NEUTRAL_SCORE)
        else:
            fifth = F.lit(1)
            for place in fifth_edges(n):
                fifth = fifth + found[place].at_or_after().cast("int")
            score = 6 - fifth if measure == "recency" else fifth
        scored = scored.withColumn("value", F.col(measure).cast("double")).withColumn(name, score)
    scores = {name: F.col(name) for name in ("r", "f", "m")}
    return scored.drop("value").withColumns({"rfm": sum(scores.values(), F.lit(0)), "segment": segment(scores)})


def rfm_totals(base: DataFrame) -> DataFrame:
    """Customers (one row each in ``base``), their orders and their revenue."""
    return base.agg(
        F.count("customer_id").alias("customers"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("orders"),
        money_sum(F.col("monetary")).alias("monetary"),
    )


def segment_summary(scores: DataFrame) -> DataFrame:
    grouped = scores.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.sum("frequency").alias("orders"),
        money_sum(F.col("monetary")).alias("monetary"),
    ).withColumn("avg_monetary", F.col("monetary") / F.col("customers"))
    return with_share(grouped, "customers", "share_customers_pct").orderBy(
        F.desc("monetary"), "segment"
    )


def top_customers(scores: DataFrame, k: int = 50) -> DataFrame:
    return top(scores, k, F.desc("monetary"), F.desc("frequency"), F.col("customer_id"))


def rfm_sum_histogram(scores: DataFrame, bins: int = 10) -> DataFrame:
    return histogram(scores, "rfm", bins).withColumnRenamed("orders", "customers")
