"""Joins in place over buckets, splits drawn in one pass, a trend over arriving files."""

import pytest
from pyspark.sql import functions as F

from contract.queries import marketplace
from waybill.operators import topk
from waybill.operators.classification import drawn_split
from waybill.plans import trends
from waybill.plans.facts import build_facts
from waybill.sources.sinks import bucketed_sources
from waybill.streaming.trend import follow_daily_trend, followed_trend

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_bucketed_sources_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = bucketed_sources(marketplace.load(spark, FOLDER), 5)
        columns = ["order_id", "gross_revenue", "paid_value", "payment_type", "review_score", "on_time"]
        assert exchanges(build_facts(src, columns)) == []
        assert exchanges(build_facts(src, columns, review_mode="mean")) == []
        # Only the customers, joined last, have to be brought together.
        assert len(exchanges(build_facts(src))) == 2
        assert len(exchanges(build_facts(marketplace.load(spark, FOLDER), columns))) >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(t.name.startswith("waybill_") for t in spark.catalog.listTables())


@pytest.mark.parametrize("share", [0.2, {0: 0.5, 1: 0.1}])
def test_drawn_split_is_near_its_shares_and_repeatable(spark, share):
    rows = spark.range(30_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("late"))
    one = drawn_split(rows, ["id"], test_share=share)
    two = drawn_split(rows.repartition(7, F.rand(3)).filter("id % 2 = 0"), ["id"], test_share=share)
    assert one.join(two, ["id", "is_test"]).count() == 15_000
    for row in one.groupBy("late").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect():
        p = share[row.late] if isinstance(share, dict) else share
        assert abs(row.k - row.n * p) <= 5 * (row.n * p * (1 - p)) ** 0.5
    assert exchanges(one) == []
    assert drawn_split(rows, ["id"], test_share={1: 1.0}).filter("is_test").count() == 10_000


SCHEMA = "order_id long, purchase_dt timestamp, purchase_date date, gross_revenue double"


def deliver(spark, folder, rows):
    made = spark.createDataFrame(rows, "order_id long, t string, gross_revenue double")
    at = F.col("t").cast("timestamp")
    made.select("order_id", at.alias("purchase_dt"), F.to_date(at).alias("purchase_date"), "gross_revenue").coalesce(1).write.mode("append").parquet(folder)


def follow(spark, root, name, lateness="3 days"):
    query = follow_daily_trend(spark, f"{root}/facts", f"{root}/trend", SCHEMA, name, lateness, files_per_batch=1)
    query.awaitTermination()
    return query


def test_trend_follows_arriving_files_and_late_rows(spark, tmp_path):
    root = str(tmp_path)
    deliveries = [
        [(1, "2020-01-01 10:00:00", 1.25), (2, "2020-01-02 23:59:59", 2.0), (3, None, 9.0)],
        [(4, "2020-01-01 00:00:00", 3.5), (5, "2020-01-04 12:00:00", float("nan"))],
        [(6, "2020-01-02 00:00:00", 4.0), (7, "2020-01-05 08:00:00", 0.01)],
    ]
    for number, rows in enumerate(deliveries):
        deliver(spark, f"{root}/facts", rows)
        follow(spark, root, f"trend_{number}")
        whole = trends.daily_trend(spark.read.schema(SCHEMA).parquet(f"{root}/facts"), 2)
        got = followed_trend(spark, f"{root}/trend", 2)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    # Beyond the watermark a row is left out, and the query says so.
    deliver(spark, f"{root}/facts", [(8, "2019-12-01 08:00:00", 5.0), (9, "2020-01-05 09:00:00", 1.0)])
    query = follow(spark, root, "trend_late")
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) >= 1
    days = {str(r.purchase_date): r.orders for r in followed_trend(spark, f"{root}/trend", 0).collect()}
    assert "2019-12-01" not in days and days["2020-01-05"] == 2
    # Nothing new: nothing changes.
    follow(spark, root, "trend_again")
    assert {str(r.purchase_date): r.orders for r in followed_trend(spark, f"{root}/trend", 0).collect()} == days


@pytest.mark.parametrize("spread", [1, 40, 100_000])
def test_newest_and_oldest_by_counting_equal_a_sort(spark, monkeypatch, spread):
    """Few moments, some and many; small limits send the search through all its steps."""
    monkeypatch.setattr(topk, "SORTED_ROWS", 20)
    monkeypatch.setattr(topk, "BUCKETS", 16)
    second = F.when(F.col("id") % 9 > 0, F.pmod(F.col("id") * 7919, F.lit(spread)))
    df = spark.range(400).select(
        F.timestamp_seconds(1_500_000_000 + second).alias("order_purchase_timestamp"), F.format_string("o%03d", "id").alias("order_id")
    ).repartition(4)
    rows = sorted(((r[0] is None, r[0] or 0, r[1]) for r in df.collect()), key=lambda r: (r[0], str(r[1]), r[2]))
    for n in (1, 30, 45, 200, 399, 400, 500):
        assert sorted(r.order_id for r in topk.oldest(df, n).collect()) == sorted(r[2] for r in rows[:n]), n
        assert sorted(r.order_id for r in topk.newest(df, n).collect()) == sorted(r[2] for r in rows[::-1][:n]), n
