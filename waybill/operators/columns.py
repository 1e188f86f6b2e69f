"""Schema repair."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from waybill.functions.timing import year_month


def ensure_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are absent; existing ones are left alone."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def repair_facts(facts: DataFrame) -> DataFrame:
    """Complete a fact table from another producer to what the reports read."""
    facts = ensure_columns(
        facts,
        {
            "order_status": F.lit("unknown"),
            "payment_type": F.lit("unknown"),
            "customer_state": F.lit("NA"),
            "installments": F.lit(1),
            "gross_revenue": F.lit(0.0),
            "on_time": F.lit(None).cast("boolean"),
            "delivery_time_h": F.lit(None).cast("double"),
            "delay_h": F.lit(None).cast("double"),
            "review_score": F.lit(None).cast("double"),
        },
    )
    if "purchase_dt" not in facts.columns:
        facts = facts.withColumn(
            "purchase_dt", F.col("order_purchase_timestamp").try_cast("timestamp")
        )
    return ensure_columns(
        facts,
        {
            "purchase_date": F.to_date("purchase_dt"),
            "ym": year_month(F.col("purchase_dt")),
        },
    )


def fill_measures(facts: DataFrame, *measures: str) -> DataFrame:
    """Missing measures count as 0 (how the profit scenarios read the facts)."""
    return facts.fillna(0.0, subset=list(measures or ("gross_revenue", "delivery_time_h", "delay_h")))


def with_customer_key(facts: DataFrame, key: str = "customer_id") -> DataFrame:
    """Use the order as customer where no customer is known for any row."""
    if key not in facts.columns:
        return facts.withColumn(key, F.col("order_id"))
    # A maximum, unlike a count, lets Catalyst drop the joins under the subquery.
    nobody_known = facts.agg(F.max(key).isNull()).scalar()
    return facts.withColumn(key, F.when(nobody_known, F.col("order_id")).otherwise(F.col(key)))
