"""Key figures of any period from small stored summaries, without the facts.

A summary holds, per purchase day and state, the exact additive figures (rows, punctual
rows, revenue) and a HyperLogLog sketch of the order ids, and per month and review score
a quantile sketch of the delivery hours.  Summaries merge: those of the days of a period
give the period's figures, whichever days that are.  They are partitioned by month, so
that a refresh of some months rewrites only these, and a period reads only its own.

Distinct counts are within ``distinct_bound`` and ranks within ``rank_bound`` of the
exact ones but in very rare cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.money import money_parts, money_total

# Size of the sketches as powers of two and items.
HLL_BITS = 14
KLL_ITEMS = 1024

DAY_COLUMNS = (
    "purchase_date date, customer_state string, rows long, punctual long, units long, millionths long, orders_sketch binary, ym string"
)
HOUR_COLUMNS = "review_score double, n long, hours_sketch binary, ym string"


def distinct_bound(bits: int = HLL_BITS) -> float:
    """Relative error of a distinct count that is hardly ever exceeded: three deviations."""
    return 3 * 1.04 / 2 ** (bits / 2)


def rank_bound(items: int = KLL_ITEMS) -> float:
    """Error of a share of rows that is hardly ever exceeded: twice the one at 99 %."""
    return 2 * 2.446 / items**0.9433


def day_summaries(facts: DataFrame, bits: int = HLL_BITS) -> DataFrame:
    """One row per purchase day and state."""
    return facts.groupBy("ym", "purchase_date", "customer_state").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("on_time").alias("punctual"),
        *(part.alias(name) for part, name in zip(money_parts(F.col("gross_revenue")), ("units", "millionths"), strict=True)),
        # Texts of one type, so that summaries of any source merge.
        F.hll_sketch_agg(F.col("order_id").cast("string"), bits).alias("orders_sketch"),
    )


def hour_summaries(facts: DataFrame, items: int = KLL_ITEMS) -> DataFrame:
    """One row per month and review score, over the rows that were delivered."""
    hours = facts.filter(F.col("delivery_time_h").isNotNull())
    return hours.groupBy("ym", "review_score").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(delivery_time_h, {int(items)})").alias("hours_sketch")
    )


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Store summaries by month; months that are there already and come again are replaced."""
    ordered = summaries.repartition("ym").sortWithinPartitions(*(c for c in ("purchase_date", "review_score") if c in summaries.columns))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def read_summaries(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def in_days(days: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Summaries of the days from ``start`` to ``end``, both included; only their months are read."""
    kept = days.filter(F.col("purchase_date").isNotNull())
    if start is not None:
        kept = kept.filter((F.col("purchase_date") >= F.lit(start)) & (F.col("ym") >= F.lit(f"{start:%Y-%m}")))
    if end is not None:
        kept = kept.filter((F.col("purchase_date") <= F.lit(end)) & (F.col("ym") <= F.lit(f"{end:%Y-%m}")))
    return kept


def metrics(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct orders (estimated), on-time percent and revenue (exact) per group of summaries."""
    return days.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("orders_sketch")).alias("orders"),
        (100 * F.sum("punctual") / F.sum("rows")).alias("on_time_pct"),
        money_total(F.sum("units"), F.sum("millionths")).alias("revenue"),
    )


def merged_hours(hours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and one quantile sketch per group of summaries."""
    return hours.groupBy(*by).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(hours_sketch)").alias("hours_sketch"))


def quantile(share: float) -> Column:
    """Delivery hours at a share of the rows, from a merged sketch."""
    return F.call_function("kll_sketch_get_quantile_double", F.col("hours_sketch"), F.lit(float(share)))


def ranks(hours: Sequence[float]) -> Column:
    """Shares of the rows with at most so many delivery hours each, from a merged sketch."""
    return F.call_function("kll_sketch_get_rank_double", F.col("hours_sketch"), F.array(*(F.lit(float(h)) for h in hours)))


def hours_box(hours: DataFrame, by: Sequence[str] = ("review_score",)) -> DataFrame:
    """Quartiles of the delivery hours per group of summaries."""
    merged = merged_hours(hours, by)
    return merged.select(*by, "n", quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))


def hours_histogram(hours: DataFrame, width: float, bins: int) -> DataFrame:
    """Estimated rows per interval of ``width`` hours from 0 on, all groups together."""
    # A rank counts what is at most its value; a little less leaves the edge out.
    below = merged_hours(hours).select("n", ranks([k * width - 1e-9 for k in range(bins + 1)]).alias("below"))
    shares = F.zip_with(F.slice("below", 1, bins), F.slice("below", 2, bins), lambda low, high: high - low)
    counted = below.select("n", F.posexplode(shares).alias("bin", "share"))
    return counted.select("bin", (F.col("bin") * float(width)).alias("from_h"), F.round(F.col("share") * F.col("n")).cast("long").alias("rows"))
