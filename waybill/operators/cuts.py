"""Exact order statistics by counting, for tables too large to sort.

To find the row at a wanted place in an order, rows are counted in ``BUCKETS`` intervals
between the least and the greatest value, then only in the interval that holds the
place, until it holds one value.  Ties go on with the next order column.  Each step is
one grouped count with a map-side combine; no row is sorted, moved or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

# Intervals counted at once, over all places sought.
BUCKETS = 65_536
# Groups whose places are sought together; their totals pass through the driver.
MAX_GROUPS = 10_000
_CHUNK = 7  # bytes of a text that make one number


@dataclass(frozen=True)
class Cut:
    """The row at a place: values of the first order columns that settle it."""

    columns: tuple[Column, ...]
    values: tuple

    def at_or_after(self) -> Column:
        """Whether a row stands at the cut's place or after it."""
        out = F.lit(True)
        for column, value in reversed(list(zip(self.columns, self.values, strict=True))):
            out = (column > F.lit(value)) | ((column == F.lit(value)) & out)
        return out

    def after(self) -> Column:
        return self.at_or_after() & ~self.same()

    def same(self) -> Column:
        out = F.lit(True)
        for column, value in zip(self.columns, self.values, strict=True):
            out = out & (column == F.lit(value))
        return out


def _numbers(df: DataFrame, name: str) -> Iterator[Column]:
    """Numbers whose order is the column's order, the coarsest first."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, StringType):
        longest = df.agg(F.max(F.octet_length(name))).first()[0] or 0
        raw = column.cast("binary")
        for start in range(0, longest, _CHUNK):
            piece = F.rpad(F.substring(raw, start + 1, _CHUNK), _CHUNK, F.lit(b"\0"))
            yield F.conv(F.hex(piece), 16, 10).cast("long")
        yield F.octet_length(name).cast("long")
    elif isinstance(kind, TimestampType):
        yield F.unix_micros(column)
    elif isinstance(kind, TimestampNTZType):
        yield F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, DateType):
        yield F.unix_date(column).cast("long")
    elif isinstance(kind, (DoubleType, FloatType)):
        yield column.cast("double")
    else:
        yield column.cast("long")


def _level(df: DataFrame, value: Column, group: Sequence[str], places: dict[tuple, set[int]]) -> dict:
    """(value, rows before, rows with it) at each place of each group."""
    kind = "double" if df.select(value.alias("v")).schema["v"].dataType == DoubleType() else "long"
    rows = df.select(*group, value.alias("_v")).filter("_v IS NOT NULL")
    first = rows.groupBy(*group).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n"))
    found, open_ = {}, []
    for row in first.collect():
        key = tuple(row[g] for g in group)
        open_ += [(key, place, row.lo, row.hi, 0, row.n) for place in places.get(key, ())]
    spark = df.sparkSession
    kinds = ", ".join(["_id int", *(f"_g{k} {df.schema[g].dataType.simpleString()}" for k, g in enumerate(group)), f"_lo {kind}", f"_hi {kind}"])
    while True:
        for key, place, lo, hi, before, n in open_:
            if lo == hi:
                found[key, place] = (lo, before, n)
        open_ = [x for x in open_ if x[2] != x[3]]
        if not open_:
            return found
        spans = list(dict.fromkeys((key, lo, hi) for key, _, lo, hi, _, _ in open_))
        number = {span: k for k, span in enumerate(spans)}
        buckets = max(16, BUCKETS // len(spans))
        table = spark.createDataFrame([(number[s], *s[0], s[1], s[2]) for s in spans], kinds)
        match = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for k, g in enumerate(group):
            match = match & rows[g].eqNullSafe(F.col(f"_g{k}"))
        share = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        # One row per group and place: bounded by MAX_GROUPS.
        counted = rows.join(F.broadcast(table), match).groupBy("_id", bucket.alias("_b")).agg(
            F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        by_span: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: (r._id, r._b)):
            by_span.setdefault(row._id, []).append(row)
        narrowed = []
        for key, place, lo, hi, before, _ in open_:
            for row in by_span[number[key, lo, hi]]:
                if before + row.n >= place:
                    narrowed.append((key, place, row.lo, row.hi, before, row.n))
                    break
                before += row.n
        open_ = narrowed


def cuts(
    df: DataFrame, order: Sequence[str], places: Callable[[int], Sequence[int]], group: Sequence[str] = ()
) -> dict[tuple, tuple[int, dict[int, Cut]]]:
    """Per group its number of rows and the cut at each wanted place (from 1).

    ``places`` gives the places wanted in a group of n rows.  ``order`` names columns
    of numbers, times or texts, ascending; rows with a null in the first are left out.
    Rows that agree in all order columns share a cut.
    """
    group = list(group)
    known = df.filter(F.col(order[0]).isNotNull()).select(*dict.fromkeys([*group, *order]))
    totals = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(totals) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    out = {tuple(r[g] for g in group): (r.n, {}) for r in totals if r.n}
    # Each open place: its group, place, place among the rows left, and its values so far.
    open_ = [(key, p, p, ()) for key, (n, _) in out.items() for p in sorted(set(places(n)))]
    columns: list[Column] = []
    left, names = known, list(group)
    numbers = (number for name in order for number in _numbers(known, name))
    while open_:
        number = next(numbers, None)
        if number is None:  # equal in everything: one cut
            for key, place, _, values in open_:
                out[key][1][place] = Cut(tuple(columns), values)
            break
        wanted: dict[tuple, set[int]] = {}
        for key, _, rest, values in open_:
            wanted.setdefault((*key, *values), set()).add(rest)
        found = _level(left, number, names, wanted)
        columns.append(number)
        still = []
        for key, place, rest, values in open_:
            value, before, ties = found[(*key, *values), rest]
            if ties == 1:
                out[key][1][place] = Cut(tuple(columns), (*values, value))
            else:
                still.append((key, place, rest - before, (*values, value)))
        open_ = still
        name = f"_cut{len(columns)}"
        left = left.withColumn(name, number)
        if open_:
            left = left.filter(F.col(name).isin(*{v[-1] for *_, v in open_}))
        names.append(name)
    return out
