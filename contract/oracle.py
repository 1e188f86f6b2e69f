"""SQL twins of the registered queries, in DuckDB's dialect.

Written from the semantics, not from the Spark plans: money is added as decimal,
ranks and percentiles use the engine's own functions.
"""

from __future__ import annotations

from waybill.plans.geo import STATE_CENTERS, STATE_CODES

ORACLE: dict[str, str] = {}

# --- building blocks ---------------------------------------------------------

_CODES = ", ".join(f"'{c}'" for c in [*STATE_CODES[:23], "XX", "YY"])

SOURCES = f"""
s_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'P' THEN 'shipped' ELSE 'delivered' END AS order_status,
         bought AS order_purchase_timestamp,
         bought + to_hours(o_orderkey % 12) AS order_approved_at,
         CASE WHEN o_orderstatus <> 'P' THEN bought + to_hours(12 + o_orderkey % 12) END
           AS order_delivered_carrier_date,
         CASE WHEN o_orderstatus <> 'P'
              THEN bought + to_hours(24 * (1 + (o_orderkey * 37) % 30) + (o_orderkey * 13) % 24) END
           AS order_delivered_customer_date,
         o_orderdate + INTERVAL 22 DAY AS order_estimated_delivery_date
  FROM (SELECT *, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS bought FROM orders)
),
s_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS freight_value
  FROM lineitem
),
s_payments AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL
              WHEN o_orderpriority[1] IN ('1', '5') THEN 'credit_card'
              WHEN o_orderpriority[1] = '2' THEN 'boleto'
              WHEN o_orderpriority[1] = '3' THEN 'voucher'
              WHEN o_orderpriority[1] = '4' THEN 'debit_card' END AS payment_type,
         CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments,
         CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
  FROM orders WHERE o_orderkey % 100 <> 7
  UNION ALL
  SELECT o_orderkey, 2, 'voucher', 1, 10.0 FROM orders WHERE o_orderkey % 20 = 0
),
s_reviews AS (
  SELECT o_orderkey AS order_id, CAST(1 + (o_orderkey * 31) % 5 AS DOUBLE) AS review_score
  FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL
  SELECT o_orderkey, 5.0 FROM orders WHERE o_orderkey % 40 = 1
),
s_customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 97 <> 0 THEN ([{_CODES}])[c_nationkey + 1] END AS customer_state
  FROM customer
),
s_sellers AS (
  SELECT s_suppkey AS seller_id,
         CASE WHEN s_suppkey % 25 <> 0 THEN ([{_CODES}])[s_nationkey + 1] END AS seller_state
  FROM supplier
),
s_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 33 <> 0 THEN CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
         CAST((p_size + 10) * (p_size % 7 + 2) * (p_size % 11 + 5) AS DOUBLE) AS volume_cm3
  FROM part
)"""


def _facts(orders: str = "s_orders", reviews: str = "s_reviews") -> str:
    return f"""
f_items AS (
  SELECT order_id, count(product_id) AS items_cnt, sum(price) AS gross_revenue,
         sum(freight_value) AS freight
  FROM s_items GROUP BY order_id
),
f_payments AS (
  SELECT order_id,
         arg_min(payment_type, payment_sequential) FILTER (payment_type IS NOT NULL) AS payment_type,
         max(payment_installments) AS installments, sum(payment_value) AS paid_value
  FROM s_payments GROUP BY order_id
),
facts AS (
  SELECT o.*, i.items_cnt, CAST(coalesce(i.gross_revenue, 0) AS DECIMAL(18,2)) AS gross_revenue,
         i.freight, coalesce(p.payment_type, 'unknown') AS payment_type,
         CAST(coalesce(p.installments, 1) AS INTEGER) AS installments,
         CAST(coalesce(p.paid_value, 0) AS DECIMAL(18,2)) AS paid_value,
         r.review_score, coalesce(c.customer_state, 'NA') AS customer_state,
         o.order_purchase_timestamp AS purchase_dt,
         CAST(o.order_purchase_timestamp AS DATE) AS purchase_date,
         coalesce(strftime(o.order_purchase_timestamp, '%Y-%m'), 'NaT') AS ym,
         coalesce(o.order_delivered_customer_date <= o.order_estimated_delivery_date, false) AS on_time,
         epoch_us(o.order_delivered_customer_date - o.order_purchase_timestamp) / 3.6e9 AS delivery_time_h,
         CASE WHEN o.order_delivered_customer_date IS NULL THEN NULL
              WHEN o.order_delivered_customer_date < o.order_estimated_delivery_date THEN 0.0
              ELSE epoch_us(o.order_delivered_customer_date - o.order_estimated_delivery_date) / 3.6e9
         END AS delay_h
  FROM {orders} o
  LEFT JOIN f_items i ON o.order_id = i.order_id
  LEFT JOIN f_payments p ON o.order_id = p.order_id
  LEFT JOIN {reviews} r ON o.order_id = r.order_id
  LEFT JOIN s_customers c ON o.customer_id = c.customer_id
)"""


FACTS = f"WITH {SOURCES},{_facts()}"

REVENUE = "CAST(coalesce(sum(gross_revenue), 0) AS DOUBLE)"
AOV = f"round({REVENUE} / nullif(count(*), 0), 6)"
RATE = "round(avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END), 6)"
SHARE = "round(100.0 * count(*) / sum(count(*)) OVER (), 6)"


def _on_facts(name: str, body: str) -> None:
    ORACLE[name] = f"{FACTS}\n{body}"


# --- sources and facts -------------------------------------------------------

ORACLE["source_counts"] = f"WITH {SOURCES}\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS source, count(*) AS rows FROM s_{name}"
    for name in ("orders", "items", "payments", "reviews", "customers", "products", "sellers")
)

_TIMES = ", ".join(
    f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
    for c in (
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date", "purchase_dt",
    )
)
_on_facts("facts_table", f"""
SELECT order_id, customer_id, order_status, {_TIMES}, items_cnt,
       CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(freight AS DOUBLE) AS freight,
       payment_type, installments, CAST(paid_value AS DOUBLE) AS paid_value, review_score,
       customer_state, purchase_date, ym, on_time,
       round(delivery_time_h, 6) AS delivery_time_h, round(delay_h, 6) AS delay_h
FROM facts""")

ORACLE["facts_one_row_per_order"] = f"""
WITH {SOURCES},
mean_reviews AS (SELECT order_id, avg(review_score) AS review_score FROM s_reviews GROUP BY order_id),
{_facts(reviews="mean_reviews")}
SELECT order_id, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
       CAST(paid_value AS DOUBLE) AS paid_value, round(review_score, 6) AS review_score
FROM facts"""

_on_facts("facts_of_year", """
SELECT order_id, ym, purchase_date, items_cnt, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
       CAST(freight AS DOUBLE) AS freight
FROM facts WHERE year(purchase_dt) = 1997""")

ORACLE["facts_newest"] = f"""
WITH {SOURCES},
kept AS (
  SELECT * FROM s_orders ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id DESC LIMIT 10000
),
{_facts(orders="kept")}
SELECT order_id, purchase_date, CAST(gross_revenue AS DOUBLE) AS gross_revenue, payment_type,
       review_score, customer_state
FROM facts"""

_on_facts("facts_repaired", f"""
SELECT ym, 'unknown' AS payment_type, 'NA' AS customer_state, CAST(1 AS INTEGER) AS installments,
       count(DISTINCT order_id) AS customers, count(*) AS unrated, CAST(0 AS DOUBLE) AS delay_h,
       {REVENUE} AS revenue
FROM facts GROUP BY ym""")

_PERIOD = "purchase_date BETWEEN DATE '1996-03-01' AND DATE '1998-09-15'"
_KPIS = f"SELECT count(*) AS orders, {REVENUE} AS revenue, coalesce({AOV}, 0) AS aov, {RATE} AS on_time_rate"
_on_facts("facts_from_sink", f"{_KPIS} FROM facts WHERE {_PERIOD}")

ORACLE["orders_from_csv"] = f"""
WITH {SOURCES}
SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS year, order_status,
       count(order_id) AS orders, count(order_delivered_customer_date) AS delivered
FROM s_orders GROUP BY ALL"""

ORACLE["newest_orders"] = f"""
WITH {SOURCES}
SELECT order_id, order_status,
       strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp
FROM (SELECT * FROM s_orders
      ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id DESC LIMIT 10000)"""

ORACLE["oldest_delivered_orders"] = f"""
WITH {SOURCES}
SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp
FROM (SELECT * FROM s_orders WHERE order_status = 'delivered'
      ORDER BY order_purchase_timestamp ASC NULLS LAST, order_id LIMIT 10000)"""

_on_facts("date_bounds",
          "SELECT min(purchase_date) AS min_date, max(purchase_date) AS max_date FROM facts")

ORACLE["facts_refreshed"] = ORACLE["facts_bucketed"] = ORACLE["facts_table"]
ORACLE["date_bounds_stored"] = ORACLE["date_bounds"]

# --- sales -------------------------------------------------------------------

_on_facts("home_metrics", f"""
SELECT count(DISTINCT order_id) AS orders,
       round(100 * avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END), 6) AS on_time_pct,
       {REVENUE} AS revenue
FROM facts""")
_on_facts("period_metrics_stored", f"""
SELECT customer_state, count(DISTINCT order_id) AS orders,
       round(100 * avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END), 6) AS on_time_pct, {REVENUE} AS revenue, TRUE AS within_bound
FROM facts WHERE {_PERIOD} GROUP BY customer_state""")
_on_facts("delivery_box_stored", """
SELECT review_score, count(*) AS orders, TRUE AS q1_near, TRUE AS median_near, TRUE AS q3_near
FROM facts WHERE review_score IS NOT NULL AND delivery_time_h IS NOT NULL GROUP BY review_score""")
_on_facts("delivery_histogram_stored", """
SELECT CAST(b AS INTEGER) AS bin, count(delivery_time_h) AS rows, TRUE AS within_bound
FROM range(40) r(b) LEFT JOIN facts ON floor(delivery_time_h / 24) = b GROUP BY b""")
_on_facts("kpis", f"{_KPIS} FROM facts")
_on_facts("kpis_of_period", f"{_KPIS} FROM facts WHERE {_PERIOD}")
_on_facts("kpis_last_year",
          f"{_KPIS} FROM facts WHERE year(purchase_dt) = (SELECT max(year(purchase_dt)) FROM facts)")


def _daily(rows: int) -> str:
    return f""",
by_day AS (
  SELECT purchase_date, count(*) AS orders, {REVENUE} AS revenue FROM facts GROUP BY purchase_date
)
SELECT purchase_date, orders, revenue,
       CASE WHEN count(*) OVER w = {rows} THEN round(avg(orders) OVER w, 4) END AS orders_ma,
       CASE WHEN count(*) OVER w = {rows} THEN round(avg(revenue) OVER w, 4) END AS revenue_ma
FROM by_day
WINDOW w AS (ORDER BY purchase_date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"""


_on_facts("daily_trend_ma", _daily(7))
ORACLE["daily_trend_followed"] = ORACLE["daily_trend_ma"]
_on_facts("daily_trend_ma30", _daily(30))
_on_facts("monthly_trend",
          f"SELECT ym, count(*) AS orders, {REVENUE} AS revenue, {AOV} AS aov FROM facts GROUP BY ym")
_on_facts("dow_hour_heatmap", """
SELECT CAST(isodow(purchase_dt) - 1 AS INTEGER) AS dow_index, CAST(hour(purchase_dt) AS INTEGER) AS hour,
       dayname(purchase_dt) AS dow, count(*) AS orders
FROM facts GROUP BY ALL""")
_HOURS = ", ".join(
    f"count(*) FILTER (hour(purchase_dt) = {h}) AS h{h:02d}" for h in range(24)
)
_on_facts("dow_hour_grid", f"""
SELECT CAST(isodow(purchase_dt) - 1 AS INTEGER) AS dow_index, dayname(purchase_dt) AS dow, {_HOURS}
FROM facts GROUP BY ALL""")

# --- delivery ----------------------------------------------------------------

_on_facts("sla_kpis", f"""
SELECT {RATE} AS on_time_rate, round(avg(delivery_time_h), 6) AS avg_delivery_h,
       round(avg(delay_h), 6) AS avg_delay_h
FROM facts""")
_on_facts("sla_kpis_delivered", f"""
SELECT {RATE} AS on_time_rate, round(avg(delivery_time_h), 6) AS avg_delivery_h,
       round(avg(delay_h), 6) AS avg_delay_h
FROM facts WHERE order_delivered_customer_date IS NOT NULL""")
_on_facts("sla_daily", f"""
SELECT purchase_date, {RATE} AS on_time_rate, count(*) AS orders FROM facts GROUP BY purchase_date""")


def _histogram(value: str, condition: str) -> str:
    return f""",
v AS (SELECT {value} AS x FROM facts WHERE {condition}),
b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 40.0 AS w FROM v),
h AS (
  SELECT CAST(least(floor((x - lo) / w), 39) AS INTEGER) AS bin, count(*) AS orders
  FROM v, b GROUP BY 1
)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, orders
FROM h, b"""


_on_facts("delivery_histogram", _histogram("delivery_time_h", "delivery_time_h IS NOT NULL"))
_on_facts("delay_histogram", _histogram("delay_h", "delay_h > 0"))
_on_facts("whatif_late_simple", """
SELECT round(CAST(coalesce(sum(gross_revenue) FILTER (NOT on_time), 0) AS DOUBLE) * 5.0 / 100, 6)
         AS recaptured_revenue
FROM facts""")


def _mean_hours(start: str, end: str) -> str:
    return f"round(avg(epoch_us({end} - {start}) / 3.6e9), 6)"


_on_facts("stage_times", f"""
SELECT order_status, count(*) AS orders,
       {_mean_hours('order_purchase_timestamp', 'order_approved_at')} AS approval_h,
       {_mean_hours('order_approved_at', 'order_delivered_carrier_date')} AS processing_h,
       {_mean_hours('order_delivered_carrier_date', 'order_delivered_customer_date')} AS shipping_h,
       {_mean_hours('order_purchase_timestamp', 'order_delivered_customer_date')} AS delivery_h
FROM facts GROUP BY order_status""")

# --- payments ----------------------------------------------------------------

_on_facts("payments_kpis",
          f"SELECT count(*) AS orders, {REVENUE} AS revenue, coalesce({AOV}, 0) AS aov FROM facts")
_BY_TYPE = f"""
SELECT payment_type, count(*) AS orders, {REVENUE} AS revenue,
       round(avg(installments), 6) AS installments_avg, max(installments) AS installments_max,
       {AOV} AS aov, {SHARE} AS share_pct
FROM facts GROUP BY payment_type"""
_on_facts("payments_by_type", _BY_TYPE)
_on_facts("payments_breakdown", f"""
SELECT payment_type, count(*) AS orders, {REVENUE} AS revenue, {AOV} AS aov, {SHARE} AS share_pct
FROM facts GROUP BY payment_type""")
_on_facts("payments_by_installments", f"""
SELECT installments, count(*) AS orders, {REVENUE} AS revenue, {AOV} AS aov, {SHARE} AS share_pct
FROM facts GROUP BY installments""")
_on_facts("payments_presented", f"""
SELECT payment_type, orders, format('${{:,.0f}}', revenue) AS revenue,
       format('{{:,.2f}}', installments_avg) AS installments_avg, installments_max,
       format('${{:,.2f}}', aov) AS aov, format('{{:,.1f}}%', share_pct) AS share_pct
FROM ({_BY_TYPE})""")

# --- reviews -----------------------------------------------------------------

_on_facts("reviews_kpis", f"""
SELECT round(avg(review_score), 6) AS avg_score, {RATE} AS on_time_rate,
       round(avg(delay_h), 6) AS avg_delay_h
FROM facts""")
_on_facts("review_distribution", f"""
SELECT review_score, count(*) AS orders, {SHARE} AS share_pct FROM facts GROUP BY review_score""")
_on_facts("reviews_by_score", f"""
SELECT review_score, count(*) AS orders, {RATE} AS on_time_rate,
       round(avg(delivery_time_h), 6) AS delivery_time_h, round(avg(delay_h), 6) AS delay_h
FROM facts GROUP BY review_score""")
_on_facts("delivery_box_by_score", """,
v AS (SELECT review_score, delivery_time_h AS x FROM facts
      WHERE review_score IS NOT NULL AND delivery_time_h IS NOT NULL),
q AS (
  SELECT review_score, count(*) AS orders, min(x) AS lo, quantile_cont(x, 0.25) AS q1,
         quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS hi
  FROM v GROUP BY review_score
)
SELECT v.review_score, orders, round(lo, 6) AS min_value, round(q1, 6) AS q1, round(q2, 6) AS median,
       round(q3, 6) AS q3, round(hi, 6) AS max_value,
       round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 6) AS lower_fence,
       round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 6) AS upper_fence
FROM v JOIN q ON v.review_score = q.review_score
GROUP BY v.review_score, orders, lo, q1, q2, q3, hi""")
_on_facts("promoter_score", """
SELECT count(review_score) AS scored, count(*) FILTER (review_score = 5) AS promoters,
       count(*) FILTER (review_score <= 3) AS detractors,
       round(100.0 * (count(*) FILTER (review_score = 5) - count(*) FILTER (review_score <= 3))
             / count(review_score), 6) AS nps
FROM facts""")

# --- customers ---------------------------------------------------------------


def _fifth(value: str) -> str:
    """Equal-frequency fifth of the rank (ties by customer)."""
    rank = f"row_number() OVER (ORDER BY {value}, customer_id)"
    return f"CAST(greatest(1, (({rank} - 1) * 5 + count(*) OVER () - 2) // (count(*) OVER () - 1)) AS INTEGER)"


RFM = f""",
base AS (
  SELECT customer_id,
         CAST(floor(epoch_us((SELECT max(purchase_dt) + INTERVAL 1 DAY FROM facts) - max(purchase_dt))
                    / 86400e6) AS BIGINT) AS recency,
         count(*) AS frequency, sum(gross_revenue) AS monetary
  FROM facts WHERE customer_id IS NOT NULL GROUP BY customer_id
),
marks AS (
  SELECT *, 6 - {_fifth('recency')} AS r, {_fifth('frequency')} AS f, {_fifth('monetary')} AS m FROM base
),
rfm AS (
  SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
         CAST(r AS INTEGER) AS r, f, m, CAST(r + f + m AS INTEGER) AS rfm,
         CASE WHEN least(r, f, m) >= 4 THEN 'Champions'
              WHEN r >= 4 AND f >= 3 THEN 'Loyal'
              WHEN r <= 2 AND f >= 3 THEN 'At Risk'
              WHEN greatest(r, f, m) <= 2 THEN 'Hibernating'
              WHEN r >= 4 THEN 'New'
              ELSE 'Others' END AS segment
  FROM marks
)"""
_on_facts("rfm_scores", f"{RFM} SELECT * FROM rfm")
_on_facts("rfm_segments", f"""{RFM}
SELECT segment, count(*) AS customers, CAST(sum(frequency) AS BIGINT) AS orders,
       CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS monetary,
       round(CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_monetary,
       round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_customers_pct
FROM rfm GROUP BY segment""")
_on_facts("rfm_totals", f"""{RFM}
SELECT count(*) AS customers, CAST(sum(frequency) AS BIGINT) AS orders,
       CAST(sum(monetary) AS DOUBLE) AS monetary
FROM base""")
_on_facts("rfm_top_customers", f"""{RFM}
SELECT * FROM rfm ORDER BY monetary DESC, frequency DESC, customer_id LIMIT 50""")
_on_facts("report_rfm", f"""{RFM}
SELECT * FROM rfm ORDER BY monetary DESC, frequency DESC, customer_id LIMIT 30""")
_on_facts("rfm_sum_histogram", f"""{RFM},
b AS (SELECT min(rfm) AS lo, (max(rfm) - min(rfm)) / 10.0 AS w FROM rfm),
h AS (SELECT CAST(least(floor((rfm - lo) / w), 9) AS INTEGER) AS bin, count(*) AS customers
      FROM rfm, b GROUP BY 1)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, customers
FROM h, b""")

# --- scenarios ---------------------------------------------------------------

ROI = f""",
freq AS (SELECT customer_id, count(*) AS n FROM facts WHERE customer_id IS NOT NULL GROUP BY customer_id),
roi AS (
  SELECT count(*) AS orders, {REVENUE} AS revenue, {REVENUE} / count(*) AS aov,
         1 - avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS late_rate,
         CAST(coalesce(sum(gross_revenue) FILTER (NOT on_time), 0) AS DOUBLE) AS late_revenue,
         (SELECT quantile_cont(n, 0.25) FROM freq) AS q1
  FROM facts
),
risk AS (
  SELECT count(*) AS at_risk_customers, CAST(coalesce(sum(n), 0) AS BIGINT) AS at_risk_orders
  FROM freq WHERE n <= (SELECT q1 FROM roi)
)"""
_on_facts("roi_base", f"""{ROI}
SELECT orders, revenue, round(aov, 6) AS aov, round(late_rate, 6) AS late_rate, late_revenue,
       round(CAST(q1 AS DOUBLE), 6) AS q1_orders, at_risk_customers, at_risk_orders
FROM roi, risk""")


def _late(cut: str, margin: str) -> dict[str, str]:
    late_cut = f"(late_rate - greatest(late_rate - ({cut}) / 100.0, 0))"
    kept = f"(revenue * late_rate * 0.10 * {late_cut} / greatest(late_rate, 1e-9))"
    return {"late_cut": late_cut, "recaptured_revenue": kept, "late_profit": f"({kept} * ({margin}) / 100.0)"}


def _winback(coverage: str, uplift: str, margin: str) -> dict[str, str]:
    extra = f"(at_risk_orders * (({coverage}) / 100.0) * (({uplift}) / 100.0))"
    return {"extra_orders": extra, "winback_profit": f"({extra} * aov * ({margin}) / 100.0)"}


def _cross(coverage: str, uplift: str, margin: str) -> dict[str, str]:
    extra = f"(revenue * (({coverage}) / 100.0) * (({uplift}) / 100.0))"
    return {"extra_revenue": extra, "cross_profit": f"({extra} * ({margin}) / 100.0)"}


def _list(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({sql}, {digits}) AS {name}" for name, sql in columns.items())


_ALL = {**_late("5", "55"), **_winback("20", "10", "55"), **_cross("20", "5", "55")}
_ALL["total_profit"] = f"({_ALL['late_profit']} + {_ALL['winback_profit']} + {_ALL['cross_profit']})"
_on_facts("roi_late", f"{ROI} SELECT {_list(_late('5', '55'), 4)} FROM roi")
_on_facts("roi_agent_late", f"""{ROI}
SELECT round(late_revenue * 5 / 100.0, 6) AS recaptured_revenue,
       round(late_revenue * 5 / 100.0 * 55 / 100.0, 6) AS profit FROM roi""")
_on_facts("roi_winback", f"{ROI} SELECT {_list(_winback('20', '10', '55'), 4)} FROM roi, risk")
_on_facts("roi_cross_sell", f"{ROI} SELECT {_list(_cross('20', '5', '55'))} FROM roi")
_on_facts("roi_total", f"{ROI} SELECT {_list(_ALL)} FROM roi, risk")
_GRID = {
    "late_profit": _late("late_cut_pp", "margin_pct")["late_profit"],
    "winback_profit": _winback("winback_coverage_pct", "10", "margin_pct")["winback_profit"],
    "cross_profit": _cross("20", "5", "margin_pct")["cross_profit"],
}
_GRID["total_profit"] = f"({_GRID['late_profit']} + {_GRID['winback_profit']} + {_GRID['cross_profit']})"
_on_facts("roi_grid", f"""{ROI}
SELECT margin_pct, late_cut_pp, winback_coverage_pct, {_list(_GRID)}
FROM roi, risk,
     (SELECT CAST(unnest([30, 55, 80]) AS DOUBLE) AS margin_pct),
     (SELECT CAST(unnest([0, 5, 20]) AS DOUBLE) AS late_cut_pp),
     (SELECT CAST(unnest([0, 20, 80]) AS DOUBLE) AS winback_coverage_pct)""")
_on_facts("roi_cancellations", """,
c AS (
  SELECT count(*) AS orders, count(*) FILTER (order_status = 'shipped') AS lost_orders,
         CAST(coalesce(sum(gross_revenue) FILTER (order_status = 'shipped'), 0) AS DOUBLE) AS lost_revenue
  FROM facts
)
SELECT orders, lost_orders, round(lost_orders / orders, 6) AS lost_rate, lost_revenue,
       round(lost_revenue * 10 / 100.0, 6) AS kept_revenue,
       round(lost_revenue * 10 / 100.0 * 55 / 100.0, 6) AS profit
FROM c""")

# --- states ------------------------------------------------------------------

_CENTERS = ", ".join(f"('{s}', {lat}, {lon})" for s, (lat, lon) in STATE_CENTERS.items())
SELLER_STATE = """
seller_state AS (
  SELECT order_id,
         arg_min(seller_state, (order_item_id, product_id, i.seller_id))
           FILTER (seller_state IS NOT NULL) AS seller_state
  FROM s_items i LEFT JOIN s_sellers s ON i.seller_id = s.seller_id
  GROUP BY order_id
)"""


def _states(column: str, source: str = "facts") -> str:
    return f""",
centers AS (
  SELECT state, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon
  FROM (VALUES {_CENTERS}) AS c(state, lat, lon)
),
states AS (
  SELECT {column} AS state, count(*) AS orders, avg(CASE WHEN on_time THEN 1.0 ELSE 0.0 END) AS rate,
         avg(delivery_time_h / 24) AS delivery_days, avg(delay_h / 24) AS delay_days,
         count(delivery_time_h) AS delivered, any_value(lat) AS lat, any_value(lon) AS lon
  FROM {source} JOIN centers ON {column} = centers.state
  GROUP BY {column}
)"""


_STATE_COLUMNS = """
SELECT state, orders, round(rate, 6) AS on_time_rate, round(delivery_days, 6) AS avg_delivery_days,
       round(delay_days, 6) AS avg_delay_days, delivered, lat, lon
FROM states"""
_on_facts("geo_customer_state", _states("customer_state") + _STATE_COLUMNS)
_on_facts("geo_seller_state", f""",{SELLER_STATE},
placed AS (SELECT f.*, seller_state FROM facts f LEFT JOIN seller_state s ON f.order_id = s.order_id)
{_states('seller_state', 'placed')}{_STATE_COLUMNS}""")
_on_facts("geo_overall", f"""{_states('customer_state')}
SELECT CAST(sum(orders) AS BIGINT) AS orders, round(sum(rate * orders) / sum(orders), 6) AS on_time_rate,
       round(sum(delivery_days * orders) / sum(orders), 6) AS avg_delivery_days
FROM states""")
_on_facts("geo_presented", f"""{_states('customer_state')},
shown AS (SELECT *, round_even(rate * 100, 1) AS pct FROM states)
SELECT state, orders, pct AS on_time_pct, round(delivery_days, 6) AS avg_delivery_days,
       round(delay_days, 6) AS avg_delay_days, lat, lon,
       'State: ' || state || '<br>Orders: ' || format('{{:,}}', orders)
       || '<br>On-time: ' || format('{{:,.1f}}%', pct)
       || '<br>Mean delivery (days): ' || format('{{:,.1f}}', delivery_days)
       || '<br>Mean delay (days): ' || format('{{:,.1f}}', delay_days) AS hint
FROM shown""")
ORACLE["order_seller_state"] = f"WITH {SOURCES},{SELLER_STATE} SELECT order_id, seller_state FROM seller_state"

# --- late-delivery risk ------------------------------------------------------


def _training(orders: str = "(SELECT * FROM s_orders WHERE order_status = 'delivered')") -> str:
    return f"""WITH {SOURCES},
features AS (
  SELECT order_id, count(i.product_id) AS items_cnt, CAST(sum(freight_value) AS DOUBLE) AS freight_value,
         sum(coalesce(product_weight_g, 0)) / 1000 AS total_weight_kg,
         sum(coalesce(volume_cm3, 0)) / 1000 AS total_volume_dm3
  FROM s_items i LEFT JOIN s_products p ON i.product_id = p.product_id
  GROUP BY order_id
),
state_counts AS (
  SELECT order_id, seller_state, count(*) AS n
  FROM s_items i JOIN s_sellers s ON i.seller_id = s.seller_id
  WHERE seller_state IS NOT NULL GROUP BY ALL
),
commonest AS (
  SELECT order_id, seller_state FROM state_counts
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC, seller_state) = 1
),
training AS (
  SELECT o.order_id, coalesce(payment_sequential, 0) AS payment_sequential,
         CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS weekday,
         CAST(hour(order_purchase_timestamp) AS INTEGER) AS hour,
         epoch_us(order_estimated_delivery_date - order_purchase_timestamp) / 86400e6 AS promised_days,
         coalesce(items_cnt, 1) AS items_cnt, coalesce(freight_value, 0) AS freight_value,
         coalesce(total_weight_kg, 0) AS total_weight_kg,
         coalesce(total_volume_dm3, 0) AS total_volume_dm3,
         CAST(coalesce(payment_installments, 1) AS INTEGER) AS payment_installments,
         CAST(coalesce(customer_state = seller_state, false) AS INTEGER) AS same_state,
         payment_type, customer_state, seller_state,
         CAST(coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS INTEGER)
           AS late
  FROM {orders} o
  LEFT JOIN s_customers c ON o.customer_id = c.customer_id
  LEFT JOIN s_payments p ON o.order_id = p.order_id
  LEFT JOIN features f ON o.order_id = f.order_id
  LEFT JOIN commonest m ON o.order_id = m.order_id
)"""


TRAINING = _training()
ORACLE["risk_training_table"] = f"""{TRAINING}
SELECT * REPLACE (round(promised_days, 6) AS promised_days, round(freight_value, 6) AS freight_value,
                  round(total_weight_kg, 6) AS total_weight_kg,
                  round(total_volume_dm3, 6) AS total_volume_dm3,
                  CAST(payment_sequential AS INTEGER) AS payment_sequential)
FROM training"""
_OLDEST = _training(
    "(SELECT * FROM s_orders WHERE order_status = 'delivered' "
    "ORDER BY order_purchase_timestamp NULLS LAST, order_id LIMIT 10000)"
)
ORACLE["risk_oldest_training_table"] = f"""{_OLDEST}
SELECT seller_state, late, count(*) AS rows, CAST(sum(same_state) AS BIGINT) AS same_state,
       CAST(sum(items_cnt) AS BIGINT) AS items
FROM training GROUP BY seller_state, late"""
ORACLE["risk_one_row_per_order"] = f"""WITH {SOURCES},
paid AS (
  SELECT order_id,
         arg_min(payment_type, payment_sequential) FILTER (payment_type IS NOT NULL) AS payment_type,
         max(payment_installments) AS installments
  FROM s_payments GROUP BY order_id
)
SELECT payment_type, CAST(coalesce(installments, 1) AS INTEGER) AS payment_installments,
       CAST(coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS INTEGER) AS late,
       count(*) AS rows, CAST(sum(hour(order_purchase_timestamp)) AS BIGINT) AS hours
FROM s_orders o LEFT JOIN paid p ON o.order_id = p.order_id
WHERE order_status = 'delivered' GROUP BY 1, 2, 3"""
ORACLE["risk_class_weights"] = f"""{TRAINING}
SELECT late, count(*) AS n,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM training GROUP BY late"""
ORACLE["risk_split_sizes"] = f"""{TRAINING},
classes AS (SELECT late, count(*) AS n, sum(count(*)) OVER () AS total FROM training GROUP BY late),
quota AS (
  SELECT late, n, CAST(total - ceil(total * 0.2) AS DOUBLE) AS wanted,
         n * CAST(total - ceil(total * 0.2) AS DOUBLE) / total AS exact
  FROM classes
),
placed AS (
  SELECT late, n, floor(exact)
         + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, n DESC)
                     <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_train
  FROM quota
)
SELECT late, false AS is_test, CAST(n_train AS BIGINT) AS rows FROM placed
UNION ALL SELECT late, true, CAST(n - n_train AS BIGINT) FROM placed"""
ORACLE["risk_summary"] = f"""{TRAINING}
SELECT count(*) AS rows, round(100 * avg(late), 6) AS late_pct FROM training"""
SCORED = f"""{TRAINING},
scored AS (SELECT late, ((24 - hour) * 4 + items_cnt % 4) / 100.0 AS score FROM training)"""
ORACLE["risk_confusion"] = f"""{SCORED}
SELECT count(*) FILTER (late = 0 AND score < 0.5) AS true_on_time,
       count(*) FILTER (late = 0 AND score >= 0.5) AS false_late,
       count(*) FILTER (late = 1 AND score < 0.5) AS false_on_time,
       count(*) FILTER (late = 1 AND score >= 0.5) AS true_late
FROM scored"""
ORACLE["risk_auc"] = f"""{SCORED},
ranks AS (
  SELECT late, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) - 1
                + count(*) OVER (PARTITION BY score)) / 2.0 AS mid_rank
  FROM scored
),
sums AS (
  SELECT sum(mid_rank) FILTER (late = 1) AS r, CAST(sum(late) AS DOUBLE) AS p,
         CAST(count(*) - sum(late) AS DOUBLE) AS q
  FROM ranks
)
SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM sums"""

# --- SQL, reports, texts, baskets --------------------------------------------

_on_facts("sql_top_payments", f"""
SELECT payment_type, count(*) AS orders, {REVENUE} AS revenue
FROM facts GROUP BY payment_type ORDER BY revenue DESC, payment_type LIMIT 10""")
_on_facts("sql_worst_states", """,
rated AS (SELECT customer_state, sum(CASE WHEN on_time THEN 1 ELSE 0 END) AS good, count(*) AS orders FROM facts GROUP BY ALL)
SELECT customer_state, round(good::DOUBLE / orders, 6) AS on_time_rate, orders
FROM rated WHERE orders > 100 ORDER BY good::DOUBLE / orders, customer_state LIMIT 10""")
_on_facts("sql_monthly", f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS ym, count(*) AS orders, {REVENUE} AS revenue
FROM facts GROUP BY 1""")
_on_facts("sql_free_query", """
SELECT customer_state, order_status, orders,
       CAST(rank() OVER (PARTITION BY order_status ORDER BY orders DESC) AS INTEGER) AS place
FROM (SELECT customer_state, order_status, count(*) AS orders FROM facts
      GROUP BY ROLLUP (customer_state, order_status))
WHERE customer_state IN (SELECT customer_state FROM facts WHERE on_time
                         EXCEPT SELECT customer_state FROM facts WHERE customer_state = 'NA')""")
_on_facts("report_by_name", """
SELECT review_score, count(*) AS orders, round(avg(delivery_time_h), 6) AS delivery_time_h,
       round(avg(delay_h), 6) AS delay_h
FROM facts GROUP BY review_score""")


def _routes(text: str, routes: list[tuple[str, str]], default: str) -> str:
    """The first route whose pattern occurs in the lower-cased text."""
    cases = " ".join(f"WHEN regexp_matches(lower({text}), '{stems}') THEN '{route}'" for route, stems in routes)
    return f"CASE {cases} ELSE '{default}' END AS route"


_TEST_STEMS = [
    ("trend", "äch|üch"), ("payments_breakdown", "queque"), ("reviews_summary", "menteaux|oiñ"),
    ("rfm", "schau"), ("roi_reduce_late", "thea|ñó"), ("kpis", "zzz"),
]
ORACLE["text_routing"] = f"""
SELECT conv_id, turn, {_routes("text", _TEST_STEMS, "kpis")}
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(text) ELSE text END AS text FROM conversations)"""
# The stems that ask for a report, in the order in which they are tried.
_STEMS = [
    ("kpis", "kpi|замовлен|виручк|aov|середн|прибут"),
    ("trend", "тренд|динамік|по днях|time series"),
    ("payments_breakdown", "оплат|payment|розстроч|installments|кредит"),
    ("reviews_summary", "review|оцінк|відгук|nps"),
    ("rfm", "rfm|сегмент|клієнтські сегменти"),
    ("roi_reduce_late", "простроч|late|on-time|sla|затримк"),
]
ORACLE["text_routing_words"] = f"""
SELECT conv_id, turn, {_routes("text", _STEMS, "kpis")}
FROM (SELECT conv_id, turn, text || ' ' || (['KPI за рік', 'Динаміка продажів', 'time series please',
  'Скільки Оплат', 'installments', 'Відгуки', 'NPS now', 'RFM', 'сегменти', 'Late deliveries', 'простроченi',
  'nothing at all'])[conv_id % 12 + 1] AS text FROM conversations)"""

_on_facts("report_names", """
SELECT 'kpis' AS report, 1 AS rows UNION ALL SELECT 'roi_reduce_late', 1
UNION ALL SELECT 'trend', count(DISTINCT CAST(order_purchase_timestamp AS DATE)) FROM facts
UNION ALL SELECT 'payments_breakdown', count(*) FROM (SELECT payment_type FROM facts GROUP BY payment_type)
UNION ALL SELECT 'reviews_summary', count(*) FROM (SELECT review_score FROM facts GROUP BY review_score)
UNION ALL SELECT 'rfm', least(30, count(DISTINCT customer_id)) FROM facts""")

BASKETS = """
WITH lines AS (
  SELECT DISTINCT l_orderkey AS basket, p_brand AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
total AS (SELECT count(DISTINCT basket) AS baskets, ceil(0.015 * count(DISTINCT basket)) AS least FROM lines),
singles AS (SELECT item, count(*) AS n FROM lines GROUP BY item),
pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS baskets
  FROM lines a JOIN lines b ON a.basket = b.basket AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM total)
)"""
ORACLE["basket_pairs"] = f"{BASKETS} SELECT * FROM pairs"
ORACLE["basket_rules"] = f"""{BASKETS},
directed AS (
  SELECT item_a AS antecedent, item_b AS consequent, baskets AS n FROM pairs
  UNION ALL SELECT item_b, item_a, baskets FROM pairs
)
SELECT antecedent, consequent, round(d.n / t.baskets, 6) AS support, round(d.n / a.n, 6) AS confidence,
       round((d.n / a.n) / (c.n / t.baskets), 6) AS lift
FROM directed d JOIN singles a ON a.item = antecedent JOIN singles c ON c.item = consequent, total t"""

ORACLE["basket_triples"] = """
WITH lines AS (
  SELECT DISTINCT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey
),
total AS (SELECT count(DISTINCT basket) AS baskets, ceil(0.05 * count(DISTINCT basket)) AS least FROM lines),
singles AS (SELECT item, count(*) AS n FROM lines GROUP BY item),
pairs AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM lines a JOIN lines b ON a.basket = b.basket AND a.item < b.item
  GROUP BY 1, 2),
triples AS (
  SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS n
  FROM lines a JOIN lines b ON a.basket = b.basket AND a.item < b.item
  JOIN lines c ON a.basket = c.basket AND b.item < c.item
  GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT least FROM total)
),
rules AS (
  SELECT x, y, z AS consequent, n FROM triples UNION ALL SELECT x, z, y, n FROM triples UNION ALL SELECT y, z, x, n FROM triples
)
SELECT r.x || ' + ' || r.y AS antecedent, consequent, round(r.n / t.baskets, 6) AS support,
       round(r.n / p.n, 6) AS confidence, round((r.n / p.n) / (s.n / t.baskets), 6) AS lift
FROM rules r JOIN pairs p ON p.x = r.x AND p.y = r.y JOIN singles s ON s.item = consequent, total t"""

ORACLE["discount_totals"] = """
WITH d AS (
  SELECT l_returnflag, l_linestatus, l_orderkey,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount FROM lineitem
)
SELECT l_returnflag, l_linestatus, CAST(sum(discount) AS DOUBLE) AS discount,
       CAST(coalesce(sum(discount) FILTER (l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0), 0) AS DOUBLE) AS known,
       CAST(sum(CAST(discount AS DECIMAL(24,6)) * 0.01) AS DOUBLE) AS fine
FROM d GROUP BY l_returnflag, l_linestatus"""
ORACLE["absent_sources"] = f"""WITH {SOURCES}
SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS year, order_status, count(*) AS orders, CAST(0 AS BIGINT) AS reviews,
       count(*) AS keys
FROM s_orders GROUP BY 1, 2"""
ORACLE["hot_order_reviews"] = """
WITH reviews AS (
  SELECT * FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey END AS order_id,
                        1 + o_orderkey * 31 % 5 AS score FROM orders)
)
SELECT o_orderstatus AS status, o_custkey % 10 AS ring, count(*) AS rows, count(score) AS reviews,
       CAST(sum(score) AS BIGINT) AS score, CAST(1 AS BIGINT) AS hot_keys
FROM orders LEFT JOIN reviews ON o_orderkey = order_id GROUP BY 1, 2"""

_PLACED = "CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS place"
_on_facts("payments_by_type", f"""
SELECT *, {_PLACED.format(order="revenue DESC, payment_type")} FROM ({_BY_TYPE})""")
_on_facts("payments_value_by_installments", f"""
SELECT *, {_PLACED.format(order="aov DESC, installments")} FROM (
SELECT installments, count(*) AS orders, {REVENUE} AS revenue, {AOV} AS aov, {SHARE} AS share_pct
FROM facts GROUP BY installments)""")

SPLIT = f"""{TRAINING},
drawn AS (
  SELECT *, count(*) OVER (PARTITION BY late) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY late
    ORDER BY md5('42:' || order_id || ':' || payment_sequential), order_id, payment_sequential) AS rn
  FROM training
),
classes AS (
  SELECT DISTINCT late, n, CAST(total - ceil(total * 0.2) AS DOUBLE) AS wanted,
         n * CAST(total - ceil(total * 0.2) AS DOUBLE) / total AS exact
  FROM drawn
),
quota AS (
  SELECT late, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, n DESC)
           <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_train
  FROM classes
),
split AS (SELECT d.*, rn > n_train AS is_test FROM drawn d JOIN quota q ON d.late = q.late)"""
ORACLE["risk_split_drawn"] = f"""{TRAINING},
drawn AS (
  SELECT late, CAST('0x' || left(md5('42:' || coalesce(CAST(order_id AS VARCHAR), '') || ':'
    || coalesce(CAST(payment_sequential AS VARCHAR), '')), 12) AS BIGINT) / 281474976710656.0::DOUBLE AS place
  FROM training
)
SELECT late, count(*) AS rows, count(*) FILTER (place < CASE late WHEN 0 THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END) AS test_rows,
       TRUE AS near_share
FROM drawn GROUP BY late"""
ORACLE["risk_split_rows"] = f"""{SPLIT}
SELECT order_id, CAST(payment_sequential AS INTEGER) AS payment_sequential, late, is_test FROM split"""
ORACLE["risk_summary"] = f"""{SPLIT}
SELECT count(*) AS rows, round(100 * avg(late), 6) AS late_pct FROM split WHERE is_test"""

FIXED = f"""{TRAINING},
linear AS (
  SELECT *, CASE WHEN order_id % 7 <> 0 THEN 2.0 + 0.05 * weekday - 0.02 * hour - 0.11 * promised_days + 0.2 * items_cnt
    + 0.0004 * freight_value + 0.01 * total_weight_kg - 0.3 * same_state
    + CASE payment_type WHEN 'boleto' THEN 0.4 WHEN 'voucher' THEN -0.2 ELSE CASE WHEN payment_type IS NULL THEN 0.7 ELSE 0 END END
    + CASE WHEN customer_state = 'SP' THEN -0.25 WHEN customer_state IS NULL THEN 0.11 ELSE 0 END
    + CASE WHEN seller_state = 'RJ' THEN 0.25 ELSE 0 END END AS x
  FROM training
),
risks AS (SELECT *, 1 / (1 + exp(-x)) AS risk FROM linear)"""
ORACLE["risk_scores"] = f"""{FIXED}
SELECT order_id, CAST(payment_sequential AS INTEGER) AS payment_sequential, payment_type, round(risk, 6) AS risk FROM risks"""
ORACLE["risk_fixed_quality"] = f"""{FIXED},
scored AS (SELECT late, round(risk, 4) AS score FROM risks WHERE risk IS NOT NULL),
ranks AS (
  SELECT late, score, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) - 1
                + count(*) OVER (PARTITION BY score)) / 2.0 AS mid_rank
  FROM scored
)
SELECT round((sum(mid_rank) FILTER (late = 1) - p * (p + 1) / 2) / (p * q), 6) AS auc,
       count(*) FILTER (late = 0 AND score < 0.5) AS true_on_time, count(*) FILTER (late = 0 AND score >= 0.5) AS false_late,
       count(*) FILTER (late = 1 AND score < 0.5) AS false_on_time, count(*) FILTER (late = 1 AND score >= 0.5) AS true_late
FROM ranks, (SELECT CAST(sum(late) AS DOUBLE) AS p, CAST(count(*) - sum(late) AS DOUBLE) AS q FROM scored) GROUP BY p, q"""
ORACLE["risk_fixed_top"] = f"""{TRAINING},
weights(feature, coef) AS (VALUES ('weekday', 0.05), ('hour', -0.02), ('promised_days', -0.11), ('items_cnt', 0.2),
  ('freight_value', 0.0004), ('total_weight_kg', 0.01), ('same_state', -0.3), ('payment_type=boleto', 0.4),
  ('payment_type=voucher', -0.2), ('payment_type=__null__', 0.7), ('customer_state=SP', -0.25),
  ('customer_state=__null__', 0.11), ('seller_state=RJ', 0.25)),
there AS (
  SELECT 'payment_type=' || coalesce(payment_type, '__null__') AS feature FROM training
  UNION SELECT 'customer_state=' || coalesce(customer_state, '__null__') FROM training
  UNION SELECT 'seller_state=' || coalesce(seller_state, '__null__') FROM training
  UNION SELECT feature FROM weights WHERE NOT contains(feature, '=')
)
SELECT feature, CAST(coef AS DOUBLE) AS coef FROM weights JOIN there USING (feature)
ORDER BY abs(coef) DESC, feature LIMIT 8"""
ORACLE["risk_encoding"] = f"""{TRAINING},
named AS (
  SELECT 'payment_type=' || coalesce(payment_type, '__null__') AS feature FROM training
  WHERE payment_type IS DISTINCT FROM 'voucher'
  UNION ALL SELECT 'customer_state=' || coalesce(customer_state, '__null__') FROM training
  UNION ALL SELECT 'seller_state=' || coalesce(seller_state, '__null__') FROM training
)
SELECT feature, count(*) AS rows FROM named GROUP BY feature
UNION ALL SELECT unnest(['weekday', 'hour', 'promised_days', 'items_cnt', 'freight_value', 'total_weight_kg',
    'total_volume_dm3', 'payment_installments', 'same_state']),
  unnest([count(*) FILTER (weekday <> 0), count(*) FILTER (hour <> 0), count(*) FILTER (promised_days <> 0),
    count(*) FILTER (items_cnt <> 0), count(*) FILTER (freight_value <> 0), count(*) FILTER (total_weight_kg <> 0),
    count(*) FILTER (total_volume_dm3 <> 0), count(*) FILTER (payment_installments <> 0), count(*) FILTER (same_state <> 0)])
FROM training"""
ORACLE["risk_slopes"] = f"""{SPLIT},
train AS (SELECT * FROM split WHERE NOT is_test)
SELECT DISTINCT 'payment_type=' || coalesce(payment_type, '__null__') AS feature, 0.0::DOUBLE AS slope FROM train
UNION SELECT 'customer_state=' || coalesce(customer_state, '__null__'), 0.0::DOUBLE FROM train
UNION SELECT 'seller_state=' || coalesce(seller_state, '__null__'), 0.0::DOUBLE FROM train
UNION SELECT unnest(['weekday', 'hour', 'promised_days', 'items_cnt', 'freight_value', 'total_weight_kg',
  'total_volume_dm3', 'payment_installments', 'same_state']), 0.0::DOUBLE"""
