"""Exact positions and running totals over a table too large to sort in one task.

``row_number()`` or ``sum() over (order by ..)`` without a partition key sends
every row to one task.  Here the rows are range-partitioned on the group and
the sort columns together (so ties on one value still spread), staged, and each
partition's local position is shifted by the totals of the partitions before.
Only those per-partition totals are ever brought together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybill.session import stage

# monotonically_increasing_id() keeps the partition number above this bit.
_PARTITION_BIT = 33
# Per-partition totals are broadcast up to this many rows, joined by shuffle beyond.
MAX_BROADCAST_CHUNKS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_CHUNKS) -> DataFrame:
    """Hint a broadcast only after counting that the table is small enough."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _most_partitions(df: DataFrame) -> int:
    """Upper limit of shuffle partitions; AQE only ever merges them."""
    conf = df.sparkSession.conf
    return int(
        conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        or conf.get("spark.sql.shuffle.partitions")
    )


def _attach(
    rows: DataFrame, chunks: DataFrame, keys: Sequence[str], max_groups: int | None
) -> DataFrame:
    """Equi-join the chunk totals back, null keys included.

    Sorted on the group first, the partitions hold at most one chunk each plus
    one for every group that starts inside one.  That bounds the broadcast when
    the number of groups is known; otherwise the chunks are counted.
    """
    if max_groups is not None and _most_partitions(rows) + max_groups <= MAX_BROADCAST_CHUNKS:
        chunks = F.broadcast(chunks)
    else:
        chunks = broadcast_if_small(chunks)
    for k in keys:
        chunks = chunks.withColumnRenamed(k, f"_c_{k}")
    match = [rows[k].eqNullSafe(chunks[f"_c_{k}"]) for k in keys]
    return rows.join(chunks, match).drop(*(f"_c_{k}" for k in keys))


def with_row_number(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "rn",
    totals: Mapping[str, Column] | None = None,
    max_groups: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its group, and group totals.

    ``order`` must end in a unique column.  ``totals`` maps output names to
    aggregates that are added up over the group (counts, sums); ``n_rows`` is
    always there.  Groups are meant to be few and may be of any size;
    ``max_groups`` is their number where the caller knows a limit.
    """
    group, totals = list(group), dict(totals or {})
    max_groups = max_groups if group else 1
    keys = [*group, *order]
    placed = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranks",
    ).withColumn("_part", F.shiftright("_at", _PARTITION_BIT))
    chunks = placed.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("_at").alias("_first"),
        *(value.alias(total) for total, value in totals.items()),
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn(
        "_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))
    ).withColumns({total: F.sum(total).over(whole) for total in ("n_rows", *totals)})
    return (
        _attach(placed, chunks, ["_part", *group], max_groups)
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_before")
    )


def with_running_totals(
    df: DataFrame, order: Sequence[str], weights: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Add ``<w>_before`` (sum over earlier rows) and ``<w>_total`` per group.

    ``order`` must be unique within a group; reduce the rows to one per distinct
    value first, which also keeps a very frequent value down to one row.
    """
    group = list(group)
    keys = [*group, *order]
    placed = stage(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()),
        "running",
    )
    chunks = placed.groupBy("_part", *group).agg(*(F.sum(w).alias(f"{w}_total") for w in weights))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns(
        {f"_{w}_base": F.coalesce(F.sum(f"{w}_total").over(earlier), F.lit(0)) for w in weights}
    ).withColumns({f"{w}_total": F.sum(f"{w}_total").over(whole) for w in weights})
    local = (
        Window.partitionBy("_part", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _attach(placed, chunks, ["_part", *group], None if group else 1)
        .withColumns(
            {
                f"{w}_before": F.col(f"_{w}_base") + F.coalesce(F.sum(w).over(local), F.lit(0))
                for w in weights
            }
        )
        .drop("_part", *(f"_{w}_base" for w in weights))
    )


def quintile(position: Column, n_rows: Column) -> Column:
    """Fifth (1..5) of a 1-based position, by equal-frequency interval edges.

    The edges are the linearly interpolated 20 % quantiles of 1..n with closed
    upper ends, which is not what ``ntile(5)`` does.  Null for a single row,
    where the edges coincide.
    """
    bucket = F.floor(((position - 1) * 5 + n_rows - 2) / F.nullif(n_rows - 1, F.lit(0)))
    return F.when(n_rows > 1, F.greatest(F.lit(1), bucket.cast("int")))


def fifth_edges(n_rows: int) -> list[int]:
    """First places of the second to the last fifth that ``quintile`` makes of n rows."""
    return [-(-(k * (n_rows - 1) + 1) // 5) + 1 for k in range(1, 5)] if n_rows > 1 else []
