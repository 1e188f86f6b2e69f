"""Sorted limits; every one has a unique last sort key, so none is arbitrary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybill.operators.cuts import Cut, cuts


# Intervals counted in one pass, and the rows of an interval that are sorted at last.
BUCKETS = 65_536
SORTED_ROWS = 100_000


def _kept(df: DataFrame, n: int, ts: str, key: str, newest_first: bool) -> DataFrame:
    """The ``n`` first rows by time and key, as a filter at the n-th row.

    One aggregate gives all counts and bounds, one grouped count the interval that holds
    the n-th row (another one only where that interval is still large), and a bounded
    top-k its exact place; the table is then read once, without a sort.  Rows that agree
    in time and key are kept or left together.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(micros.alias("_v"), key)
    total, known, low, high = rows.agg(F.count(F.lit(1)), F.count("_v"), F.min("_v"), F.max("_v")).first()
    missing = total - known
    of_missing = min(n, missing) if newest_first else max(0, min(n - known, missing))
    of_known = min(n - of_missing, known)

    def side(cut: Cut) -> Column:
        return cut.at_or_after() if newest_first else ~cut.after()

    late, kept = F.lit(of_missing > 0), F.lit(of_known > 0)
    if 0 < of_missing < missing:
        place = missing - of_missing + 1 if newest_first else of_missing
        late = side(cuts(df.filter(F.col(ts).isNull()), [key], lambda _: [place])[()][1][place])
    if 0 < of_known < known:
        place = known - of_known + 1 if newest_first else of_known
        kept = side(_nth(rows, micros, key, place, known, low, high))
    return df.filter((F.col(ts).isNotNull() & kept) | (F.col(ts).isNull() & late))


def _nth(rows: DataFrame, micros: Column, key: str, place: int, known: int, low: int, high: int) -> Cut:
    """The cut at the ``place``-th of the ``known`` rows (_v, key), of which none is below ``low``."""
    while known > SORTED_ROWS and low < high:
        share = (F.col("_v") - low).cast("double") / float(high - low)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("bucket")
        counted = rows.filter(F.col("_v").between(low, high)).groupBy(bucket).agg(
            F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")
        )
        for row in sorted(counted.collect()):  # at most BUCKETS rows
            if place <= row.n:
                known, low, high = row.n, row.low, row.high
                break
            place -= row.n
    inside = rows.filter(F.col("_v").between(low, high))
    if known > SORTED_ROWS:  # one moment: only the keys tell its rows apart
        found = cuts(inside, [key], lambda _: [place])[()][1][place]
        return Cut((micros, *found.columns), (low, *found.values))
    last = inside.orderBy("_v", key).limit(place).agg(F.max(F.struct("_v", key))).first()[0]
    return Cut((micros, F.col(key)), tuple(last))


def newest(
    df: DataFrame, n: int | None, ts: str = "order_purchase_timestamp", key: str = "order_id"
) -> DataFrame:
    """The ``n`` latest rows, in no order.  A missing time sorts after every known
    one and is therefore taken first.  No ``n`` keeps everything."""
    return df if n is None else _kept(df, n, ts, key, newest_first=True)


def oldest(
    df: DataFrame, n: int | None, ts: str = "order_purchase_timestamp", key: str = "order_id"
) -> DataFrame:
    """The ``n`` earliest rows, missing times last, in no order."""
    return _kept(df, n, ts, key, newest_first=False) if n else df


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
