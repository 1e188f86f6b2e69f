"""The TPC-H-like test tables, mapped onto the source schemas.

All mappings use integer arithmetic on the keys, so any SQL engine derives the
same sources.  Key columns stay bigint.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.money import cents, from_cents
from waybill.plans.geo import STATE_CODES
from waybill.session import configure
from waybill.sources.tables import Sources

HOUR = 3600


# Fixed schemas: a scan needs no look into the files before it is planned.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_brand string, p_size int",
}


def _scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _seconds(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    bought = _seconds(F.col("o_orderdate")) + k * 7919 % 86400
    moving = F.col("o_orderstatus") != "P"
    return _scan(spark, folder, "orders").select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(~moving, "shipped").otherwise("delivered").alias("order_status"),
        F.timestamp_seconds(bought).alias("order_purchase_timestamp"),
        F.timestamp_seconds(bought + k % 12 * HOUR).alias("order_approved_at"),
        F.when(moving, F.timestamp_seconds(bought + (12 + k % 12) * HOUR)).alias(
            "order_delivered_carrier_date"
        ),
        F.when(
            moving, F.timestamp_seconds(bought + (24 * (1 + k * 37 % 30) + k * 13 % 24) * HOUR)
        ).alias("order_delivered_customer_date"),
        F.timestamp_seconds(_seconds(F.col("o_orderdate")) + 22 * 24 * HOUR).alias(
            "order_estimated_delivery_date"
        ),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    # Price times tax rate, rounded half up to cents, in whole numbers.
    percent = F.rint(F.col("l_tax") * 100).cast("long")
    freight = F.floor((cents(F.col("l_extendedprice")) * percent + 50) / 100)
    return _scan(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        from_cents(freight).alias("freight_value"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Most orders pay once; every twentieth adds a voucher."""
    k = F.col("o_orderkey")
    method = (
        F.when(k % 50 == 0, F.lit(None))
        .when(F.col("o_orderpriority").substr(1, 1).isin("1", "5"), "credit_card")
        .when(F.col("o_orderpriority").startswith("2"), "boleto")
        .when(F.col("o_orderpriority").startswith("3"), "voucher")
        .when(F.col("o_orderpriority").startswith("4"), "debit_card")
    )
    first = F.struct(
        F.lit(1).alias("payment_sequential"),
        method.alias("payment_type"),
        (1 + k % 10).cast("int").alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
    )
    second = F.struct(
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        F.lit(10.0).alias("payment_value"),
    )
    return (
        _scan(spark, folder, "orders")
        .select(
            k.alias("order_id"),
            F.explode(F.array(F.when(k % 100 != 7, first), F.when(k % 20 == 0, second))).alias("p"),
        )
        .filter(F.col("p").isNotNull())
        .select("order_id", "p.*")
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Most orders are reviewed once, some not at all and some twice."""
    k = F.col("o_orderkey")
    scores = F.array(
        F.when(k % 9 != 0, (1 + k * 31 % 5).cast("double")), F.when(k % 40 == 1, F.lit(5.0))
    )
    return (
        _scan(spark, folder, "orders")
        .select(k.alias("order_id"), F.explode(scores).alias("review_score"))
        .filter(F.col("review_score").isNotNull())
    )


def _state(nation: Column) -> Column:
    """State code of a nation number; the last two nations are not geocoded."""
    codes = F.array(*(F.lit(c) for c in [*STATE_CODES[:23], "XX", "YY"]))
    return F.element_at(codes, nation + 1)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_custkey") % 97 != 0, _state(F.col("c_nationkey"))).alias("customer_state"),
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seller_id"),
        F.when(F.col("s_suppkey") % 25 != 0, _state(F.col("s_nationkey"))).alias("seller_state"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return _scan(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 33 != 0, (size * 100).cast("double")).alias("product_weight_g"),
        (size + 10).cast("double").alias("product_length_cm"),
        (size % 7 + 2).cast("double").alias("product_height_cm"),
        (size % 11 + 5).cast("double").alias("product_width_cm"),
    )


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Order and brand of every line item, for market-basket rules."""
    brands = _scan(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return (
        _scan(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("basket"), "l_partkey")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .select("basket", "item")
    )


def load(spark: SparkSession, folder: str, look_up: bool = False) -> Sources:
    """All sources of one folder, each made when first asked for; nothing is kept between calls.

    By construction an order has at most two reviews and two payments, so frequent orders
    are looked for only on request.
    """
    configure(spark)
    made = (orders, items, payments, reviews, customers, products, sellers)
    tables = {make.__name__: partial(make, spark, folder) for make in made}
    return Sources(**tables, hot_keys={} if look_up else {"reviews": {}, "payments": {}})
