"""Class weights, stratified splits and the quality of a binary score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from waybill.operators.cuts import cuts
from waybill.operators.ranks import broadcast_if_small, with_running_totals

# Class tables are broadcast up to this many rows.
MAX_CLASSES = 1000


def class_weights(df: DataFrame, label: str = "late") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # over one row per class
    return classes.withColumn(
        "weight",
        F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")),
    )


def with_class_weight(df: DataFrame, label: str = "late", name: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class.  ``df`` is read more than
    once, so it should be cached or staged."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(broadcast_if_small(weights, MAX_CLASSES), label)


def _train_quota(classes: dict, test_share: float) -> dict:
    """Training rows per class: proportional, the left-over rows going to the
    largest remainders."""
    total = sum(classes.values())
    wanted = total - ceil(total * test_share)
    exact = {c: n * wanted / total for c, n in classes.items()}
    quota = {c: floor(x) for c, x in exact.items()}
    order = sorted(classes, key=lambda c: (quota[c] - exact[c], -classes[c]))
    for c in order[: wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(
    df: DataFrame, keys: Sequence[str], label: str = "late", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: an exact, reproducible stratified sample of each class.

    Rows are ordered by a seeded hash of ``keys`` (unique together), so the
    split depends on the data alone, not on partitioning or arrival order.  Only the
    row at each class's quota is sought, by counting; rows are compared with it.
    """
    drawn = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    hashed = df.withColumn("_draw", F.md5(drawn.cast("binary")))
    held = hashed.select(label, "_draw", *keys).persist(StorageLevel.MEMORY_AND_DISK)  # read by every count
    try:
        counts = held.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
        if len(counts) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        classes = {row[label]: row.n for row in counts}
        quota = _train_quota(classes, test_share)
        firsts = {c: quota[c] + 1 for c in classes if 0 <= quota[c] < classes[c]}
        places = lambda n: sorted({p for c, p in firsts.items() if classes[c] == n})
        found = cuts(held, ["_draw", *keys], places, group=[label])
    finally:
        held.unpersist()
    is_test = F.lit(False)
    for c, place in firsts.items():
        here = F.col(label).eqNullSafe(F.lit(c))
        is_test = F.when(here, found[(c,)][1][place].at_or_after()).otherwise(is_test)
    return hashed.withColumn("is_test", is_test).drop("_draw")


def drawn_split(
    df: DataFrame, keys: Sequence[str], label: str = "late", test_share: float | Mapping = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: each row is drawn by itself, with its class's share as the chance.

    No pass over the rows comes first and nothing is counted, so a class's part is its
    share only on average (binomial).  The draw is a seeded hash of ``keys``: a row's
    part never changes, whatever other rows there are and however they are partitioned.
    ``test_share`` may map classes to shares; a class it does not name has none.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))
    place = F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") / float(1 << 48)
    if isinstance(test_share, Mapping):
        share = F.lit(0.0)
        for c, own in test_share.items():
            share = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(float(own))).otherwise(share)
    else:
        share = F.lit(float(test_share))
    return df.withColumn("is_test", place < share)


def predict_class(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on (the threshold itself included)."""
    return (score >= F.lit(threshold)).cast("int")


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row with the four counts; an empty cell is 0."""
    actual, guess = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((actual == 0) & (guess == 0)).alias("true_on_time"),
        F.count_if((actual == 0) & (guess == 1)).alias("false_late"),
        F.count_if((actual == 1) & (guess == 0)).alias("false_on_time"),
        F.count_if((actual == 1) & (guess == 1)).alias("true_late"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, tied scores counting half.

    Rows are counted per distinct score first; each late row then beats the
    on-time rows at lower scores, found from distributed running totals.
    """
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("late_n"),
        F.count_if(F.col(label) == 0).alias("ok_n"),
    )
    ordered = with_running_totals(per_score, order=[score], weights=["ok_n"])
    wins = F.sum(F.col("late_n") * (F.col("ok_n_before") + F.col("ok_n") / 2))
    pairs = F.sum("late_n").cast("double") * F.max("ok_n_total")
    return ordered.agg(F.try_divide(wins, pairs).alias("auc"))
