"""Column expressions and settings that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.session import stage

__all__ = ["added", "documents", "remainder", "table", "small_batches", "stage", "partitions"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, the id as a long and the text as a string."""
    kinds = {"doc_id": "long", "text": "string"}
    return docs.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in columns))


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs run inside: with whole texts and sets in
    a row, the usual ten thousand take much memory in the executor and its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for ``repartition`` by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of rows of ``width`` doubles, sixteen at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    count = parts.rdd.getNumPartitions()
    while count > 16:
        count = -(-count // 16)
        parts = parts.repartition(count).mapInArrow(run, "part binary")
    return sum((np.frombuffer(row.part, np.float64) for row in parts.collect()), np.zeros(width))
