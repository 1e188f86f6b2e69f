"""Market-basket association rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame, functions as F

from waybill.operators.itemsets import frequent_itemsets
from waybill.operators.ranks import broadcast_if_small
from waybill.session import stage


def frequent_items(distinct: DataFrame, min_support: float) -> DataFrame:
    """Items in at least that share of baskets.

    There are at most (mean basket size / min_support) of them, whatever the
    number of baskets.
    """
    baskets = distinct.agg(F.count_distinct("basket")).scalar()
    return (
        distinct.groupBy("item")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= F.ceil(baskets * F.lit(min_support)))
        .select("item", F.lit(True).alias("_frequent"))
    )


def transactions(lines: DataFrame, min_support: float) -> DataFrame:
    """One row per basket with its set of frequent items.

    ``lines`` has ``basket`` and ``item``.  Repeats are removed and rare items
    blanked before anything is gathered, so even a basket that owns a third of
    all lines becomes a set no longer than the list of frequent items.  Baskets
    left empty stay: supports are shares of all baskets.  The distinct lines
    are read several times, so they are staged.
    """
    distinct = stage(lines.select("basket", "item").distinct(), "basket-lines")
    marked = distinct.join(broadcast_if_small(frequent_items(distinct, min_support)), "item", "left")
    return marked.groupBy("basket").agg(
        F.collect_set(F.when(F.col("_frequent"), F.col("item"))).alias("items")
    )


@dataclass
class BasketRules:
    model: FPGrowthModel

    def itemsets(self) -> DataFrame:
        """Frequent itemsets (items in order) and the baskets holding them."""
        found = self.model.freqItemsets
        return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("baskets"))

    def pairs(self) -> DataFrame:
        return (
            self.itemsets()
            .filter(F.size("items") == 2)
            .select(F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), "baskets")
        )

    def rules(self) -> DataFrame:
        """Rules with support, confidence and lift."""
        found = self.model.associationRules
        return found.select(
            F.array_join(F.array_sort("antecedent"), " + ").alias("antecedent"),
            F.array_join("consequent", " + ").alias("consequent"),
            "support", "confidence", "lift",
        )


@dataclass
class BoundedRules(BasketRules):
    """The same from itemsets that were mined up to a length only."""

    found: DataFrame
    baskets: int
    min_confidence: float

    def __init__(self, found: DataFrame, baskets: int, min_confidence: float):
        self.found, self.baskets, self.min_confidence = found, baskets, min_confidence

    def itemsets(self) -> DataFrame:
        return self.found

    def rules(self) -> DataFrame:
        """Every itemset gives one rule for each of its items as the consequent."""
        sets = self.found.filter(F.size("items") > 1).select("items", "baskets", F.explode("items").alias("consequent"))
        sets = sets.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
        whole = self.found.select(F.col("items").alias("antecedent"), F.col("baskets").alias("of_antecedent"))
        single = self.found.filter(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("baskets").alias("of_consequent"))
        confidence = F.col("baskets") / F.col("of_antecedent")
        joined = sets.join(whole, "antecedent").join(single, "consequent").filter(confidence >= self.min_confidence)
        return joined.select(
            F.array_join("antecedent", " + ").alias("antecedent"), F.col("consequent").cast("string").alias("consequent"),
            (F.col("baskets") / self.baskets).alias("support"), confidence.alias("confidence"),
            (confidence / (F.col("of_consequent") / self.baskets)).alias("lift"),
        )


def mine(
    lines: DataFrame, min_support: float = 0.01, min_confidence: float = 0.0, max_length: int | None = None
) -> BasketRules:
    """Frequent itemsets, no pair of a basket ever being emitted.

    With ``max_length`` only itemsets of so many items are mined, in blocks of baskets
    (``operators/itemsets``).  Without it parallel FP-growth finds all of them, whose
    number can grow exponentially as the support falls.  The model re-reads its
    transactions for every result, hence the staging.
    """
    if max_length:
        distinct = stage(lines.select("basket", "item").distinct(), "basket-lines")
        found, baskets = frequent_itemsets(distinct, min_support, max_length)
        return BoundedRules(stage(found, "itemsets"), baskets, min_confidence)
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(stage(transactions(lines, min_support), "baskets"))
    return BasketRules(model)
