"""Sums of money."""

from pyspark.sql import functions as F

from waybill.functions.money import money_sum, money_sum_where


def test_small_amounts_and_missing_ones(spark):
    rows = [(0.004,)] * 1000 + [(float("nan"),), (None,), (-0.004,), (12.345678,)]
    df = spark.createDataFrame(rows, "x double").repartition(7)
    assert df.agg(money_sum(F.col("x"))).first()[0] == 16.341678
    assert df.agg(money_sum_where(F.col("x") > 1, F.col("x"))).first()[0] == 12.345678
    assert df.filter("x > 100").agg(money_sum(F.col("x"))).first()[0] == 0.0


def test_order_does_not_matter_and_large_totals_hold(spark):
    df = spark.range(200_000).select((F.col("id") % 1000 * 1234.56 + 0.01).alias("x"))
    totals = {df.repartition(n).agg(money_sum(F.col("x"))).first()[0] for n in (1, 5, 16)}
    assert len(totals) == 1 and abs(totals.pop() - 200 * sum(k * 1234.56 + 0.01 for k in range(1000))) < 1e-3
    strings = spark.createDataFrame([("1.5",), ("x",), (None,)], "x string")
    assert strings.agg(money_sum(F.col("x"))).first()[0] == 1.5
