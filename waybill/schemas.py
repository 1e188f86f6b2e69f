"""Fixed schemas of the source tables and of the fact table."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema of nullable columns from ``name kind, ...``; needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        "order_id string, customer_id string, order_status string, "
        "order_purchase_timestamp timestamp, order_approved_at timestamp, "
        "order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, "
        "order_estimated_delivery_date timestamp"
    ),
    "items": _schema(
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "price double, freight_value double"
    ),
    "payments": _schema(
        "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value double"
    ),
    "reviews": _schema("order_id string, review_score double"),
    "customers": _schema("customer_id string, customer_state string"),
    "products": _schema(
        "product_id string, product_weight_g double, product_length_cm double, "
        "product_height_cm double, product_width_cm double"
    ),
    "sellers": _schema("seller_id string, seller_state string"),
}

ORDER_COLUMNS = SOURCE_SCHEMAS["orders"].fieldNames()

FACT_COLUMNS = [
    *ORDER_COLUMNS,
    "items_cnt", "gross_revenue", "freight",
    "payment_type", "installments", "paid_value",
    "review_score", "customer_state",
    "purchase_dt", "purchase_date", "ym",
    "on_time", "delivery_time_h", "delay_h",
]
