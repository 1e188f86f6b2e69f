"""Histograms, exact quantiles and box-plot figures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, functions as F

from waybill.operators.cuts import Cut, cuts


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the least and greatest value.

    Bins are closed below; the greatest value belongs to the last one.  Empty
    bins give no row.  The bounds come from a one-row subquery that reads only
    the value column; counting then combines to ``bins`` rows per task before
    anything is shuffled.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    span = known.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    x, lo, width = F.col("_x"), F.col("_lo"), F.col("_width")
    slot = F.when(width > 0, F.floor((x - lo) / width)).otherwise(F.lit(0))
    return (
        # The bounds travel as two (constant) group keys, so the subquery is
        # planned once.
        known.withColumn("_span", span)
        .select(
            "_x",
            F.col("_span.lo").alias("_lo"),
            ((F.col("_span.hi") - F.col("_span.lo")) / F.lit(float(bins))).alias("_width"),
        )
        .groupBy("_lo", "_width", F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"),
            "orders",
        )
    )


def _places(probabilities: Iterable[float]) -> Callable[[int], list[int]]:
    """The places that linear interpolation needs in a group of n values."""
    return lambda n: [place for p in probabilities for place in (floor((n - 1) * p) + 1, ceil((n - 1) * p) + 1)]


def _interpolated(n: int, found: dict[int, Cut], p: float) -> float:
    at = (n - 1) * p
    low, high = (float(found[place].values[0]) for place in (floor(at) + 1, ceil(at) + 1))
    return low + (high - low) * (at - floor(at))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated exact quantiles per group, one column each.

    ``percentile()`` gathers all distinct values of a group in one task; here the
    order statistics are found by counting.
    """
    found = cuts(df, [value], _places(probabilities.values()), group)
    kinds = [f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group]
    kinds += [f"`{name}` double" for name in probabilities]
    rows = [(*key, *(_interpolated(n, at, p) for p in probabilities.values())) for key, (n, at) in found.items()]
    return df.sparkSession.createDataFrame(rows, ", ".join(kinds))


def approximate_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], group: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """The same in one pass and without staging, off by at most 1 / ``accuracy``
    of the rank.  The value returned is always one of the observations."""
    return df.groupBy(*group).agg(
        *(F.percentile_approx(value, p, accuracy).alias(name) for name, p in probabilities.items())
    )


def box_stats(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Box-plot figures per group: count, least, quartiles, greatest, fences.

    A fence is the outermost observation within 1.5 interquartile ranges of the
    box.  Rows without a value or group are left out.
    """
    group, v = list(group), F.col(value)
    known = df.na.drop(subset=[value, *group])
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # One row per group, whose number ``cuts`` bounds.
    box = F.broadcast(exact_quantiles(known, value, quartiles, group))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return known.select(*group, value).join(box, group).groupBy(*group, *quartiles).agg(
        F.count(v).alias("orders"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("lower_fence"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("upper_fence"),
    ).select(
        *group, "orders", "min_value", *quartiles, "max_value", "lower_fence", "upper_fence"
    )
