"""Converting each arriving CSV file to Parquet exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from waybill.sources.catalogue import FALLBACK_ENCODING, parsed


def ingest_new_csv(
    spark: SparkSession, incoming: str, target: str, schema: StructType, name: str,
    encoding: str | None = None, free_text: bool = False,
) -> StreamingQuery:
    """Append the CSV files not seen by earlier calls to a Parquet table.

    The checkpoint that records which files are done lies inside the target, in a
    folder that Parquet readers skip, so table and record cannot part: a new session
    goes on where the last one stopped, and the Parquet sink commits per batch.  Fields
    are read as ``read_csv`` reads them.  The query ends by itself when all files
    present are converted.  A header that differs from ``schema`` fails the batch
    rather than shifting columns.
    """
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    arriving = spark.readStream.schema(text).csv(
        incoming, header=True, encoding=encoding or FALLBACK_ENCODING, escape='"',
        enforceSchema=False, multiLine=free_text,
    )
    return (
        parsed(arriving, schema, None, decode=encoding is None)
        .writeStream.queryName(name)
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", f"{target.rstrip('/')}/_ingest")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
