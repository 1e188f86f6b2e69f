"""Small hand-written sources for the rule tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.schemas import SOURCE_SCHEMAS
from waybill.sources.tables import Sources

_STRING_TIMES = {"timestamp": "string"}


def table(spark, name, rows, columns):
    """Rows under the source's schema; columns not given are null, times are text."""
    schema = SOURCE_SCHEMAS[name]
    frame = spark.createDataFrame(
        [tuple(None if v is None else str(v) for v in row) for row in rows],
        ", ".join(f"{c} string" for c in columns),
    )
    return frame.select(
        *(
            (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


DEFAULT_COLUMNS = {
    "orders": [
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ],
    "items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    "payments": [
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value",
    ],
    "reviews": ["order_id", "review_score"],
    "customers": ["customer_id", "customer_state"],
    "products": [
        "product_id", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    ],
    "sellers": ["seller_id", "seller_state"],
}


def sources(spark, **rows) -> Sources:
    return Sources(
        **{name: table(spark, name, rows.get(name, []), cols) for name, cols in DEFAULT_COLUMNS.items()}
    )


def by(df, key):
    """Collected rows as dictionaries by one column."""
    return {row[key]: row.asDict() for row in df.collect()}
