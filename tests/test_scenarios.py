"""What-if estimates against figures worked out by hand."""

import pytest

from waybill.plans import scenarios
from waybill.plans.reports import REPORTS, run_report, tag_text

COLUMNS = "customer_id string, order_id string, gross_revenue double, on_time boolean, order_status string"


@pytest.fixture
def facts(spark):
    rows = []
    for customer, orders in {"a": 1, "b": 1, "c": 2, "d": 5, "e": 9, "f": 10}.items():
        rows += [(customer, f"{customer}{i}", 10.0, i > 0, "canceled" if i == 4 else "delivered") for i in range(orders)]
    return spark.createDataFrame([*rows, (None, "x", 20.0, True, "delivered")], COLUMNS)


def test_base_metrics(facts):
    row = scenarios.base_metrics(facts).first()
    assert (row.orders, row.revenue, row.late_revenue) == (29, 300.0, 60.0)
    assert row.aov == pytest.approx(300 / 29) and row.late_rate == pytest.approx(6 / 29)
    assert (row.q1_orders, row.at_risk_customers, row.at_risk_orders) == (1.25, 2, 2)


def test_each_scenario(facts):
    base = scenarios.base_metrics(facts)
    late = scenarios.fewer_late(base, late_cut_pp=10, margin_pct=50).first()
    assert late.late_cut == pytest.approx(0.1)
    assert late.recaptured_revenue == pytest.approx(300 * 0.10 * 0.1)
    assert late.late_profit == pytest.approx(1.5)
    assert scenarios.fewer_late(base, late_cut_pp=90).first().late_cut == pytest.approx(6 / 29)
    back = scenarios.win_back(base).first()
    assert back.extra_orders == pytest.approx(2 * 0.2 * 0.1)
    assert back.winback_profit == pytest.approx(2 * 0.02 * 300 / 29 * 0.55)
    cross = scenarios.cross_sell(base).first()
    assert cross.extra_revenue == pytest.approx(3.0) and cross.cross_profit == pytest.approx(1.65)
    total = scenarios.all_scenarios(base).first()
    assert total.total_profit == pytest.approx(total.late_profit + total.winback_profit + total.cross_profit)
    with pytest.raises(ValueError):
        scenarios.fewer_late(base, late_cut=1)


def test_grid_equals_single_runs(spark, facts):
    base = scenarios.base_metrics(facts)
    grid = spark.createDataFrame([(30.0, 0.0), (80.0, 20.0)], "margin_pct double, late_cut_pp double")
    for row in scenarios.scenario_grid(base, grid).collect():
        one = scenarios.all_scenarios(base, margin_pct=row.margin_pct, late_cut_pp=row.late_cut_pp).first()
        assert row.total_profit == pytest.approx(one.total_profit)
        assert row.cross_uplift_pct == 5.0


def test_simple_estimates(facts):
    assert scenarios.late_revenue_share(facts, 5).first()[0] == pytest.approx(3.0)
    assert scenarios.late_revenue_share(facts, -5).first()[0] == 0.0
    assert scenarios.late_revenue_share(facts.filter("on_time"), 5).first()[0] == 0.0
    row = scenarios.late_revenue_profit(facts, 10, 50, handling_cost=3).first()
    assert (row.recaptured_revenue, row.profit) == (pytest.approx(6.0), pytest.approx(3.0))
    kept = scenarios.fewer_cancellations(facts, cut_pct=50).first()
    assert (kept.lost_orders, kept.lost_revenue, kept.kept_revenue) == (3, 30.0, 15.0)


def test_nothing_gives_zero(facts):
    base = scenarios.base_metrics(facts.filter("order_id = 'none'"))
    row = scenarios.all_scenarios(base).first()
    assert row.total_profit == 0.0


def test_reports_by_name(facts):
    assert run_report("kpis", facts).first().orders == 29
    assert run_report("roi_reduce_late", facts, reduce_pp=10.0).first().recaptured_revenue == pytest.approx(6.0)
    assert len(REPORTS) == 6
    with pytest.raises(KeyError):
        run_report("weather", facts)


def test_text_goes_to_the_first_route_that_matches(spark):
    texts = ["Show KPI and trend", "Time Series please", "PAYMENT late", "nps?", "RFM", "why so late", "hello", "Яка ВИРУЧКА?", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.route for r in tag_text(rows).orderBy("i").collect()] == [
        "kpis", "trend", "payments_breakdown", "reviews_summary", "rfm", "roi_reduce_late", "kpis", "kpis", "kpis",
    ]
    own = tag_text(rows, routes=[("a", ["hello"]), ("b", ["l"])], default="-")
    assert [r.route for r in own.orderBy("i").collect()] == ["-", "b", "b", "-", "-", "b", "a", "-", "-"]
