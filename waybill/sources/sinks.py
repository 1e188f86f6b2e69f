"""Writing the fact table and pre-bucketed sources."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from waybill.operators.filters import date_bounds
from waybill.session import scratch_path
from waybill.sources.tables import Sources


def write_facts(facts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write facts as Parquet in one folder per month.

    The rebalance hint lets AQE size the files: it gathers the small months and
    splits a month that holds most of the rows over several tasks.
    """
    facts.hint("rebalance", "ym").write.mode(mode).partitionBy("ym").parquet(path)


def read_facts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan a table of ``write_facts``.  The schema keeps the folder names of
    ``ym`` text, which partition discovery might take for dates."""
    return spark.read.schema(schema).parquet(path)


def stored_date_bounds(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: first and last purchase date of a table of ``write_facts``.

    Least and greatest values stand in the footers of the Parquet files, and the reader
    that takes them from there reads no row.  It is chosen in a session of its own, and
    needs the table's whole schema, since it finds a column by its place.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # Rows without a date are all in one folder, whose files have no such statistics.
    return date_bounds(read_facts(session, path, schema).filter("ym <> 'NaT'"))


def staged_buckets(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Stage ``df`` in buckets of ``key``, one sorted file each, and return a scan of it.

    The catalogue knows the table only for the moment it takes to plan the scan; its
    files live in the shared folder like all staged tables.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    table = f"waybill_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def bucketed_sources(src: Sources, buckets: int) -> Sources:
    """The sources with everything that belongs to an order in equal buckets of it.

    The fact table's joins and sums on ``order_id`` then need no exchange, however often
    it is built from them.
    """
    apart = {name: partial(staged_buckets, getattr(src, name), "order_id", buckets, name) for name in ("orders", "items", "payments", "reviews")}
    rest = {name: partial(getattr, src, name) for name in ("customers", "products", "sellers")}
    return Sources(**apart, **rest, hot_keys=src.hot_keys, bucketed=True)


def write_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, mode: str = "errorifexists"
) -> None:
    """Save a table bucketed and sorted on its join key.

    Sources bucketed alike on ``order_id`` join into facts without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
