"""The daily trend kept up to date while files of facts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from waybill.functions.money import money_parts, money_total
from waybill.operators.moving import with_trailing_mean

STATE_COLUMNS = "purchase_date date, orders long, units long, millionths long, batch long"


def follow_daily_trend(
    spark: SparkSession, incoming: str, target: str, schema: StructType | str, name: str,
    lateness: str = "45 days", files_per_batch: int | None = None,
) -> StreamingQuery:
    """Add the Parquet files of facts not seen by earlier calls to the days' totals.

    Rows are counted by event time.  A day stays open until the watermark, the latest
    purchase seen less ``lateness``, has passed it; a late row up to then changes its
    day, one beyond it is left out and shows in the query's progress.  State is one row
    per open day.  Each micro-batch writes the days it changed to a folder of its own,
    so a batch that is repeated after a failure replaces itself.  The query ends by
    itself when all files present are counted.
    """
    arriving = spark.readStream.schema(schema)
    if files_per_batch:
        arriving = arriving.option("maxFilesPerTrigger", files_per_batch)
    units, millionths = money_parts(F.col("gross_revenue"))
    by_day = (
        arriving.parquet(incoming)
        .filter(F.col("purchase_dt").isNotNull())
        .withWatermark("purchase_dt", lateness)
        .groupBy(F.window("purchase_dt", "1 day").alias("day"))
        .agg(F.count("order_id").alias("orders"), units.alias("units"), millionths.alias("millionths"))
    )

    def write(changed: DataFrame, batch: int) -> None:
        day = F.to_date(F.col("day.start")).alias("purchase_date")
        changed.select(day, "orders", "units", "millionths").coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return (
        by_day.writeStream.queryName(name)
        .outputMode("update")
        .option("checkpointLocation", f"{target}/_progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def followed_trend(spark: SparkSession, target: str, rolling_days: int = 7) -> DataFrame:
    """``trends.daily_trend`` from the days' latest totals."""
    states = spark.read.schema(STATE_COLUMNS).parquet(target)
    latest = states.groupBy("purchase_date").agg(F.max_by(F.struct("orders", "units", "millionths"), "batch").alias("s"))
    by_day = latest.select("purchase_date", "s.orders", money_total(F.col("s.units"), F.col("s.millionths")).alias("revenue"))
    if not rolling_days:
        return by_day.orderBy("purchase_date")
    return with_trailing_mean(by_day, "purchase_date", ["orders", "revenue"], rolling_days)
