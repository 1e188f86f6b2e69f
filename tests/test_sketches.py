"""Stored summaries: merging, periods, bounds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from waybill.operators.distribution import exact_quantiles
from waybill.plans import sketches


@pytest.fixture(scope="module")
def facts(spark):
    day = F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 200).cast("int"))
    return spark.range(60_000).select(
        (F.col("id") % 40_000).cast("string").alias("order_id"), day.alias("purchase_date"), F.date_format(day, "yyyy-MM").alias("ym"),
        F.concat(F.lit("S"), F.col("id") % 3).alias("customer_state"), (F.col("id") % 4 > 0).alias("on_time"),
        (F.col("id") % 1000 / 100).alias("gross_revenue"), (F.col("id") % 5 + 1.0).alias("review_score"),
        F.when(F.col("id") % 11 > 0, F.pow(F.col("id") * 7919 % 10_007, 1.5) / 1000).alias("delivery_time_h"),
    )


def stored(spark, tmp_path, made, columns):
    sketches.write_summaries(made, str(tmp_path / "s"))
    return sketches.read_summaries(spark, str(tmp_path / "s"), columns)


def test_any_period_equals_the_facts_within_the_bound(spark, facts, tmp_path):
    days = stored(spark, tmp_path, sketches.day_summaries(facts), sketches.DAY_COLUMNS)
    for start, end in ((None, None), (date(2020, 1, 31), date(2020, 5, 2)), (date(2020, 2, 1), date(2020, 2, 1)), (date(2021, 1, 1), None)):
        (got,) = sketches.metrics(sketches.in_days(days, start, end)).collect()
        own = facts.filter(F.col("purchase_date").between(start or date(1900, 1, 1), end or date(2100, 1, 1)))
        exact = own.agg(
            F.count_distinct("order_id"), 100 * F.avg(F.col("on_time").cast("int")), F.round(F.coalesce(F.sum("gross_revenue"), F.lit(0)), 6)
        ).first()
        assert abs((got.orders or 0) - exact[0]) <= sketches.distinct_bound() * exact[0]
        assert got.on_time_pct == pytest.approx(exact[1]) and got.revenue == pytest.approx(exact[2])


def test_a_period_reads_only_its_months(spark, facts, tmp_path):
    days = stored(spark, tmp_path, sketches.day_summaries(facts), sketches.DAY_COLUMNS)
    plan = sketches.in_days(days, date(2020, 3, 5), date(2020, 3, 9))._jdf.queryExecution().executedPlan().toString()
    assert "ym#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_months_are_replaced_one_by_one(spark, facts, tmp_path):
    stored(spark, tmp_path, sketches.day_summaries(facts), sketches.DAY_COLUMNS)
    days = stored(spark, tmp_path, sketches.day_summaries(facts.filter("ym = '2020-02'")), sketches.DAY_COLUMNS)
    assert days.agg(F.sum("rows")).first()[0] == 60_000


def test_quantiles_and_histogram(spark, facts, tmp_path):
    hours = stored(spark, tmp_path, sketches.hour_summaries(facts), sketches.HOUR_COLUMNS)
    known = facts.filter("delivery_time_h IS NOT NULL")
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    bound = sketches.rank_bound()
    for row in sketches.hours_box(hours).collect():
        own = known.filter(F.col("review_score") == row.review_score)
        low = exact_quantiles(own, "delivery_time_h", {k: max(0, v - bound) for k, v in shares.items()}).first()
        high = exact_quantiles(own, "delivery_time_h", {k: v + bound for k, v in shares.items()}).first()
        assert row.n == own.count() and all(low[k] - 1e-9 <= row[k] <= high[k] + 1e-9 for k in shares)
    exact = {r.bin: r.n for r in known.groupBy(F.floor(F.col("delivery_time_h") / 100).alias("bin")).agg(F.count("*").alias("n")).collect()}
    got = sketches.hours_histogram(hours, 100.0, 12).collect()
    assert len(got) == 12
    for row in got:
        assert abs(row.rows - exact.get(row.bin, 0)) <= 2 * bound * known.count() + 1


def test_nothing(spark, facts, tmp_path):
    none = facts.filter("false")
    days = stored(spark, tmp_path, sketches.day_summaries(none), sketches.DAY_COLUMNS) if False else sketches.day_summaries(none)
    (row,) = sketches.metrics(days).collect()
    assert row.orders in (None, 0) and row.revenue == 0.0
    assert sketches.hours_box(sketches.hour_summaries(none)).collect() == []
