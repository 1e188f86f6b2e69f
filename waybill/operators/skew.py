"""A left join that survives a key holding a large share of the right side.

AQE can split a skewed *left* side of a left outer join, but never the right one.
Where the right side repeats its key without bound, the frequent keys are salted: their
right rows are dealt over several copies of the key and their few left rows repeated
once per copy.  Both sides are still planned and read once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

# A key is frequent from so many times the rows of an even task ...
HOT_TASKS = 4.0
# ... and from so many rows: below, one task handles it easily.
HOT_ROWS = 100_000
# Sketches are merged in this many groups first, so that no single task receives
# one from every input partition.
_MERGE_GROUPS = 256


def frequent_keys(
    df: DataFrame, key: str, tasks: float = HOT_TASKS, rows: int = HOT_ROWS
) -> dict:
    """Keys that would overload a task, and over how many copies to deal each.

    ``tasks`` is the load that counts as too much, in even tasks of the session's
    shuffle partitions, ``rows`` the least number of rows.  One pass with a
    frequent-items sketch per partition.  Every key returned occurs in ``df``; there
    are at most ``partitions / tasks`` of them.
    """
    known = df.filter(F.col(key).isNotNull())
    if known.isEmpty():  # there is no sketch of nothing
        return {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, int(parts / tasks))
    # A sketch's error is about 3.5 rows in this many; a quarter of the least share.
    tracked = min(1 << 20, 1 << max(10, (16 * most - 1).bit_length()))
    sketches = (
        known.select(key, (F.spark_partition_id() % _MERGE_GROUPS).alias("_group"))
        .groupBy("_group")
        .agg(
            F.count(key).alias("n"),
            F.expr(f"approx_top_k_accumulate({key}, {tracked})").alias("sketch"),
        )
    )
    found = (
        sketches.agg(F.sum("n").alias("n"), F.expr("approx_top_k_combine(sketch)").alias("sketch"))
        .select("n", F.expr(f"approx_top_k_estimate(sketch, {most})").alias("top"))
        .first()
    )
    even = found["n"] / parts
    floor = max(rows, tasks * even)
    return {
        entry["item"]: int(min(parts, entry["count"] // max(1.0, even) + 1))
        for entry in found["top"] if entry["count"] >= floor
    }


def left_join_apart(
    left: DataFrame, right: DataFrame, key: str, hot: Mapping | None = None
) -> DataFrame:
    """``left`` ⟕ ``right`` on ``key``, the ``hot`` keys dealt over copies.

    ``hot`` maps keys that occur in ``right`` to a number of copies, as given by
    ``frequent_keys``; without any this is the plain left join.  Rows are dealt by
    their place in the scan, so ``right`` should be a scan or a staged table.
    """
    if not hot:
        return left.join(right, key, "left")
    kind = right.schema[key].dataType.simpleString()
    # At most partitions / tasks rows, as ``frequent_keys`` bounds them.
    copies = F.broadcast(right.sparkSession.createDataFrame(list(hot.items()), f"_hot {kind}, _copies int"))
    shared = F.coalesce("_copies", F.lit(1))
    dealt_left = left.join(copies, F.col(key) == F.col("_hot"), "left").drop("_hot")
    dealt_left = dealt_left.withColumn("_salt", F.explode(F.sequence(F.lit(0), shared - 1)))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), shared).cast("int")
    dealt_right = right.join(copies, F.col(key) == F.col("_hot"), "left").select(
        *right.columns, place.alias("_salt"), F.lit(True).alias("_found")
    )
    joined = dealt_left.join(dealt_right, [key, "_salt"], "left")
    # A frequent key has matches; a copy that met none of them adds no row.
    return joined.filter("_copies IS NULL OR _found").drop("_salt", "_copies", "_found")
