"""Fact-table rules on hand-written rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.micro import by, sources
from waybill.functions import casts, timing
from waybill.operators import filters
from waybill.operators.columns import ensure_columns, repair_facts, with_customer_key
from waybill.operators.topk import newest, oldest
from waybill.plans import geo, payments, reviews, rfm, trends
from waybill.plans.facts import build_facts, payments_per_order
from waybill.schemas import FACT_COLUMNS

BOUGHT = "2018-01-01 10:00:00"


def order(key, bought=BOUGHT, delivered=None, promised=None, customer="c1", status="delivered"):
    return (key, customer, status, bought, delivered, promised)


def test_unknown_dates_are_not_on_time_and_have_no_delay(spark):
    cases = {
        "none": (None, None), "no_promise": ("2018-01-05 10:00:00", None),
        "no_delivery": (None, "2018-01-05 00:00:00"),
        "before": ("2018-01-04 10:00:00", "2018-01-05 00:00:00"),
        "equal": ("2018-01-05 00:00:00", "2018-01-05 00:00:00"),
        "after": ("2018-01-05 06:30:00", "2018-01-05 00:00:00"),
    }
    got = by(build_facts(sources(spark, orders=[order(k, BOUGHT, *v) for k, v in cases.items()])), "order_id")
    assert {k: v["on_time"] for k, v in got.items()} == {
        "none": False, "no_promise": False, "no_delivery": False, "before": True, "equal": True, "after": False,
    }
    assert {k: v["delay_h"] for k, v in got.items()} == {
        "none": None, "no_promise": None, "no_delivery": None, "before": 0.0, "equal": 0.0, "after": 6.5,
    }
    assert got["before"]["delivery_time_h"] == 72.0
    labels = spark.createDataFrame(list(cases.values()), "d string, p string").select(
        timing.late_label(F.col("d").cast("timestamp"), F.col("p").cast("timestamp")).alias("late")
    )
    assert [r.late for r in labels.collect()] == [0, 0, 0, 0, 0, 1]


def test_facts_have_the_fixed_columns_and_fills(spark):
    facts = build_facts(sources(spark, orders=[order("o", None, status=None)]))
    assert facts.columns == FACT_COLUMNS
    row = facts.first()
    assert (row.gross_revenue, row.paid_value, row.installments) == (0.0, 0.0, 1)
    assert (row.payment_type, row.customer_state, row.order_status) == ("unknown", "NA", "unknown")
    assert (row.items_cnt, row.freight, row.review_score, row.purchase_date) == (None,) * 4
    assert row.ym == "NaT"


def test_every_review_makes_a_row_but_payments_do_not(spark):
    src = sources(
        spark, orders=[order("o"), order("p")],
        items=[("o", 1, "x", "s", 10.10, 1.0), ("o", 2, None, "s", 0.20, None)],
        payments=[("o", 1, None, 1, 3.0), ("o", 2, "b", 5, 4.5), ("o", 3, "a", 2, None)],
        reviews=[("o", 5.0), ("o", 2.0)],
    )
    facts = build_facts(src)
    rows = facts.filter("order_id = 'o'").collect()
    assert sorted(r.review_score for r in rows) == [2.0, 5.0]
    assert {(r.items_cnt, r.gross_revenue, r.freight) for r in rows} == {(1, 10.3, 1.0)}
    assert {(r.payment_type, r.installments, r.paid_value) for r in rows} == {("b", 5, 7.5)}
    one = by(build_facts(src, review_mode="mean"), "order_id")
    assert one["o"]["review_score"] == 3.5 and one["p"]["review_score"] is None
    assert trends.kpis(facts).first().orders == 3
    assert trends.home_metrics(facts).first().orders == 2
    with pytest.raises(ValueError):
        build_facts(src, review_mode="latest")


def test_latest_review(spark):
    src = sources(spark, orders=[order("o")])
    src.reviews = spark.createDataFrame(
        [("o", 5.0, 1), ("o", 2.0, 2)], "order_id string, review_score double, answered int"
    )
    assert build_facts(src, review_mode="latest", review_order="answered").first().review_score == 2.0


def test_payment_type_is_the_first_known_in_sequence(spark):
    src = sources(spark, payments=[("o", 3, "a", 1, 1), ("o", 2, "b", 1, 1), ("o", 1, None, 1, 1), ("p", 1, None, 1, 1)])
    got = by(payments_per_order(src.payments), "order_id")
    assert (got["o"]["payment_type"], got["p"]["payment_type"]) == ("b", None)


def test_columns_decide_what_is_read(spark):
    src = sources(spark, orders=[order("o")])
    facts = build_facts(src, columns=["order_id", "on_time"])
    assert facts.columns == ["order_id", "on_time"]
    with pytest.raises(ValueError):
        build_facts(src, columns=["colour"])


LIMITED = [order("n", None), order("a", "2018-01-01 00:00:00"), order("b", "2018-01-01 00:00:00"), order("c", "2018-02-01 00:00:00")]


def test_newest_takes_missing_times_first_and_oldest_last(spark):
    orders = sources(spark, orders=LIMITED).orders
    keys = lambda df: {r.order_id for r in df.collect()}
    assert [keys(newest(orders, n)) for n in (1, 2, 3)] == [{"n"}, {"n", "c"}, {"n", "c", "b"}]
    assert keys(newest(orders, 10)) == keys(newest(orders, None)) == {"n", "a", "b", "c"}
    assert newest(orders, 0).count() == 0
    assert [keys(oldest(orders, n)) for n in (1, 3)] == [{"a"}, {"a", "b", "c"}]
    assert keys(oldest(orders, 0)) == {"n", "a", "b", "c"}


def test_limited_facts_keep_whole_orders(spark):
    src = sources(spark, orders=LIMITED, reviews=[("c", 1), ("c", 2), ("a", 3)], items=[("c", 1, "x", "s", 5, 1), ("a", 1, "x", "s", 7, 1)])
    rows = build_facts(src, max_orders=2).collect()
    assert sorted((r.order_id, r.gross_revenue) for r in rows) == [("c", 5.0), ("c", 5.0), ("n", 0.0)]


def test_year_and_period(spark):
    src = sources(spark, orders=[
        order("a", "2017-12-31 23:59:59"), order("b", "2018-01-01 00:00:00"), order("c", "2018-12-31 23:59:59"),
        order("d", "2019-01-01 00:00:00"), order("n", None),
    ])
    keys = lambda df: "".join(sorted(r.order_id for r in df.collect()))
    assert keys(build_facts(src, year=2018)) == "bc"
    assert keys(build_facts(src, year=0)) == "abcdn"
    facts = build_facts(src)
    assert keys(filters.in_period(facts, date(2017, 12, 31), date(2018, 1, 1))) == "ab"
    assert keys(filters.in_period(facts)) == "abcd"
    assert keys(filters.last_year_only(facts)) == "d"
    bounds = filters.date_bounds(facts).first()
    assert (bounds.min_date, bounds.max_date) == (date(2017, 12, 31), date(2019, 1, 1))
    assert keys(filters.late_only(facts)) == "abcdn"
    assert filters.delayed_only(facts).count() == 0


def test_unreadable_values_become_missing(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    got = rows.select(
        casts.to_number(F.col("v")).alias("n"), casts.to_number(F.col("v"), 0).alias("z"),
        casts.to_count(F.col("v"), 1).alias("c"), casts.to_timestamp(F.col("v")).alias("t"),
    ).collect()
    assert [r.n for r in got] == [1.5, None, None, None]
    assert [r.z for r in got] == [1.5, 0.0, 0.0, 0.0]
    assert [r.c for r in got] == [1, 1, 1, 1]
    assert [r.t for r in got] == [None] * 4
    assert rows.select(casts.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_ensure_columns_adds_only_what_is_absent(spark):
    df = ensure_columns(spark.createDataFrame([(1,)], "a int"), {"a": F.lit(9), "b": F.lit(2)})
    assert df.first().asDict() == {"a": 1, "b": 2}
    bare = spark.createDataFrame([("o", "2018-03-04 05:06:07")], "order_id string, order_purchase_timestamp string")
    row = repair_facts(bare).first()
    assert (row.purchase_date, row.ym, row.payment_type, row.gross_revenue) == (date(2018, 3, 4), "2018-03", "unknown", 0.0)
    assert row.on_time is None


def test_orders_stand_in_only_where_no_customer_is_known(spark):
    unknown = spark.createDataFrame([("o", None), ("p", None)], "order_id string, customer_id string")
    assert {r.customer_id for r in with_customer_key(unknown).collect()} == {"o", "p"}
    some = spark.createDataFrame([("o", "c"), ("p", None)], "order_id string, customer_id string")
    assert [r.customer_id for r in with_customer_key(some).orderBy("order_id").collect()] == ["c", None]
    assert with_customer_key(some.drop("customer_id")).first().customer_id == "o"


def test_recency_counts_whole_days(spark):
    facts = spark.createDataFrame(
        [("a", "o1", "2018-01-02 06:00:00"), ("b", "o2", "2018-01-01 05:59:00"), ("c", "o3", "2018-01-01 06:01:00"), ("c", "o4", None)],
        "customer_id string, order_id string, t string",
    ).select("*", F.col("t").cast("timestamp").alias("purchase_dt"), F.lit(1.5).alias("gross_revenue"))
    got = by(rfm.rfm_base(facts), "customer_id")
    assert {k: v["recency"] for k, v in got.items()} == {"a": 1, "b": 2, "c": 1}
    assert (got["c"]["frequency"], got["c"]["monetary"]) == (2, 3.0)


def test_rfm_scores_without_fifths_are_neutral(spark):
    base = "customer_id string, order_id string, purchase_dt timestamp, gross_revenue double"
    one = spark.createDataFrame([("a", "o", None, 1.0)], base).withColumn("purchase_dt", F.timestamp_seconds(F.lit(0)))
    row = rfm.rfm_scores(one).first()
    assert (row.r, row.f, row.m, row.rfm, row.segment) == (3, 3, 3, 9, "Others")
    some = spark.createDataFrame([(c, c, None, float(i)) for i, c in enumerate("abcde")], base)
    some = some.withColumn("purchase_dt", F.when(F.col("order_id") != "a", F.timestamp_seconds(F.col("gross_revenue").cast("long") * 86400)))
    rows = by(rfm.rfm_scores(some), "customer_id")
    assert {v["r"] for v in rows.values()} == {3}
    assert [rows[c]["m"] for c in "abcde"] == [1, 2, 3, 4, 5]


def test_segments_follow_the_first_rule_that_fits(spark):
    triples = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    rows = spark.createDataFrame(triples, "r int, f int, m int")
    got = {(x.r, x.f, x.m): x.s for x in rows.withColumn("s", rfm.segment({c: F.col(c) for c in "rfm"})).collect()}
    assert got[5, 4, 4] == "Champions" and got[4, 3, 5] == "Loyal" and got[4, 5, 3] == "Loyal"
    assert got[2, 3, 1] == "At Risk" and got[1, 2, 2] == "Hibernating" and got[1, 2, 3] == "Others"
    assert got[5, 2, 5] == "New" and got[3, 5, 5] == "Others"


def test_top_customers_are_ordered_and_unique(spark):
    scores = spark.createDataFrame([("a", 2.0, 1), ("b", 2.0, 3), ("c", 9.0, 1), ("d", 2.0, 3)], "customer_id string, monetary double, frequency int")
    assert [r.customer_id for r in rfm.top_customers(scores, 3).collect()] == ["c", "b", "d"]


def test_shares_add_up_and_missing_scores_are_a_group(spark):
    facts = build_facts(sources(spark, orders=[order(str(i)) for i in range(7)], reviews=[("0", 5), ("1", 5), ("2", 1)]))
    shares = reviews.distribution(facts).collect()
    assert [(r.review_score, r.orders) for r in shares] == [(1.0, 1), (5.0, 2), (None, 4)]
    assert sum(r.share_pct for r in shares) == pytest.approx(100)
    table = payments.by_type(facts).first()
    assert (table.payment_type, table.orders, table.aov, table.share_pct) == ("unknown", 7, 0.0, 100.0)
    score = reviews.promoter_score(facts).first()
    assert (score.scored, score.promoters, score.detractors) == (3, 2, 1)
    assert score.nps == pytest.approx(100 / 3)


def test_state_means(spark):
    facts = spark.createDataFrame(
        [("SP", "1", True, 48.0, 0.0), ("SP", "2", False, 96.0, 24.0), ("RJ", "3", False, None, None), ("ZZ", "4", True, 24.0, 0.0)],
        "customer_state string, order_id string, on_time boolean, delivery_time_h double, delay_h double",
    )
    states = geo.by_state(facts)
    got = by(states, "state")
    assert set(got) == {"SP", "RJ"}
    assert (got["SP"]["avg_delivery_days"], got["SP"]["avg_delay_days"], got["SP"]["lat"]) == (3.0, 0.5, -23.55)
    total = geo.overall(states).first()
    assert (total.orders, total.on_time_rate, total.avg_delivery_days) == (3, pytest.approx(1 / 3), 2.0)
    assert geo.overall(states, weights="delivered").first().avg_delivery_days == 3.0
    nothing = geo.overall(states.filter("orders > 99")).first()
    assert (nothing.orders, nothing.on_time_rate, nothing.avg_delivery_days) == (0, 0.0, 0.0)
    assert "Orders: 2<br>On-time: 50.0%" in by(geo.present_states(states), "state")["SP"]["hint"]


def test_first_seller_state(spark):
    src = sources(
        spark, items=[("o", 2, "x", "s2", 1, 1), ("o", 1, "x", "s1", 1, 1), ("o", 3, "x", "s3", 1, 1), ("p", 1, "x", "s1", 1, 1)],
        sellers=[("s1", None), ("s2", "RJ"), ("s3", "SP")],
    )
    got = by(geo.order_seller_state(src), "order_id")
    assert (got["o"]["seller_state"], got["p"]["seller_state"]) == ("RJ", None)


def test_half_even_rounding_and_calendar_parts(spark):
    from waybill.functions.present import currency, percent, rounded_percent
    row = spark.createDataFrame([("2024-02-29 23:30:00",)], "t string").select(
        rounded_percent(F.lit(0.00125)).alias("p"), timing.day_name(F.col("t").cast("timestamp")).alias("d"),
        timing.monday_first(F.col("t").cast("timestamp")).alias("w"), currency(F.lit(1234.5)).alias("c"),
        percent(F.lit(12.34)).alias("q"),
    ).first()
    assert (row.p, row.d, row.w, row.c, row.q) == (0.1, "Thursday", 3, "$1,234.50", "12.3%")


def test_daily_orders_add_up_to_the_total(spark):
    from contract.queries import facts_of
    folder = "/root/testdata/sf0.001"
    facts = facts_of(spark, folder, "purchase_date", "purchase_dt", "gross_revenue", "on_time").cache()
    total = trends.kpis(facts).first()
    daily = trends.daily_trend(facts).agg(F.sum("orders").alias("o"), F.sum("revenue").alias("r")).first()
    assert daily.o == total.orders and daily.r == pytest.approx(total.revenue)
    assert trends.busy_hours(facts).agg(F.sum("orders")).first()[0] == total.orders
    facts.unpersist()
