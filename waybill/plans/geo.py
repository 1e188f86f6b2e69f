"""Delivery performance per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.present import labelled_lines, percent, rounded_percent
from waybill.plans.trends import on_time_rate, order_count
from waybill.sources.tables import Sources

# Brazilian states with the approximate position of their capital.
STATE_CENTERS = {
    "AC": (-9.975, -67.824),
    "AL": (-9.649, -35.708),
    "AP": (0.035, -51.070),
    "AM": (-3.118, -60.021),
    "BA": (-12.971, -38.501),
    "CE": (-3.732, -38.526),
    "DF": (-15.793, -47.882),
    "ES": (-20.315, -40.312),
    "GO": (-16.686, -49.264),
    "MA": (-2.530, -44.306),
    "MT": (-15.601, -56.097),
    "MS": (-20.469, -54.620),
    "MG": (-19.916, -43.934),
    "PA": (-1.456, -48.503),
    "PB": (-7.115, -34.861),
    "PR": (-25.428, -49.273),
    "PE": (-8.047, -34.877),
    "PI": (-5.094, -42.804),
    "RJ": (-22.906, -43.172),
    "RN": (-5.794, -35.199),
    "RS": (-30.034, -51.230),
    "RO": (-8.761, -63.903),
    "RR": (2.823, -60.675),
    "SC": (-27.595, -48.548),
    "SP": (-23.550, -46.633),
    "SE": (-10.911, -37.071),
    "TO": (-10.184, -48.333),
}
STATE_CODES = list(STATE_CENTERS)


def state_dimension(spark: SparkSession) -> DataFrame:
    """The fixed positions as an inline table."""
    values = ", ".join(f"('{code}', {lat}D, {lon}D)" for code, (lat, lon) in STATE_CENTERS.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS centers(state, lat, lon)")


def order_seller_state(src: Sources) -> DataFrame:
    """Order → state of its first item whose seller's state is known."""
    place = F.struct("order_item_id", "product_id", "seller_id", "seller_state")
    return (
        src.items.select("order_id", "order_item_id", "product_id", "seller_id")
        .join(src.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .groupBy("order_id")
        .agg(
            F.min(F.when(F.col("seller_state").isNotNull(), place))
            .getField("seller_state")
            .alias("seller_state")
        )
    )


def with_seller_state(facts: DataFrame, src: Sources) -> DataFrame:
    return facts.join(order_seller_state(src), "order_id", "left")


def by_state(facts: DataFrame, state_col: str = "customer_state") -> DataFrame:
    """Delivery figures of every state with a known position."""
    grouped = (
        facts.groupBy(F.col(state_col).alias("state"))
        .agg(
            order_count(),
            on_time_rate(),
            (F.avg("delivery_time_h") / 24).alias("avg_delivery_days"),
            (F.avg("delay_h") / 24).alias("avg_delay_days"),
            F.count("delivery_time_h").alias("delivered"),
        )
    )
    # 27 fixed rows.
    positions = F.broadcast(state_dimension(facts.sparkSession))
    return grouped.join(positions, "state")


def overall(states: DataFrame, weights: str = "orders") -> DataFrame:
    """Order-weighted means over the states of ``by_state``.

    With ``weights="orders"`` a state without deliveries adds nothing to the
    mean delivery time but its orders still count in the denominator;
    ``weights="delivered"`` weighs by deliveries and has no such pull.
    """

    def mean_of(figure: str, weight: Column) -> Column:
        weighted = F.coalesce(F.sum(F.col(figure) * weight), F.lit(0.0))
        return weighted / F.greatest(F.sum(weight), F.lit(1))

    return states.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        mean_of("on_time_rate", F.col("orders")).alias("on_time_rate"),
        mean_of("avg_delivery_days", F.col(weights)).alias("avg_delivery_days"),
    )


def present_states(states: DataFrame) -> DataFrame:
    """Rounded figures and the hint text shown on a map."""
    pct = rounded_percent(F.col("on_time_rate"))
    one = lambda c: F.format_number(c, 1)
    return states.select(
        "state", "orders", pct.alias("on_time_pct"), "avg_delivery_days", "avg_delay_days",
        "lat", "lon",
        labelled_lines(
            ("State", F.col("state")),
            ("Orders", F.format_number("orders", 0)),
            ("On-time", percent(pct)),
            ("Mean delivery (days)", one("avg_delivery_days")),
            ("Mean delay (days)", one("avg_delay_days")),
        ).alias("hint"),
    )
