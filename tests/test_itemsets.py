"""Bounded itemsets against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.operators import itemsets
from waybill.plans import basket


def brute(baskets, share, longest):
    least = -(-len(baskets) * share // 1)
    out = {}
    for items in baskets:
        for size in range(1, longest + 1):
            for one in combinations(sorted(items), size):
                out[one] = out.get(one, 0) + 1
    return {k: n for k, n in out.items() if n >= least}


def some_baskets(n, seed):
    rng = random.Random(seed)
    return [{f"i{int(rng.paretovariate(0.8)) % 25:02}" for _ in range(rng.randrange(1, 9))} for _ in range(n)]


def lines(spark, baskets):
    return spark.createDataFrame([(b, i) for b, items in enumerate(baskets) for i in items], "basket long, item string").repartition(4)


@pytest.mark.parametrize("block", [64, 300, 1 << 14])
@pytest.mark.parametrize("longest, share", [(1, 0.02), (2, 0.01), (3, 0.05), (4, 0.02)])
def test_itemsets_equal_brute_force(spark, monkeypatch, block, longest, share):
    monkeypatch.setattr(itemsets, "CHUNK", 40)
    baskets = some_baskets(700, 3)
    found, total = itemsets.frequent_itemsets(lines(spark, baskets), share, longest, block)
    assert total == 700 and {tuple(r["items"]): r.baskets for r in found.collect()} == brute(baskets, share, longest)


def test_rules_equal_those_of_all_itemsets(spark):
    df = lines(spark, some_baskets(300, 5))
    bounded, whole = (basket.mine(df, 0.03, 0.2, max_length=k) for k in (3, None))

    def rows(rules, longest):
        return sorted(
            (r.antecedent, r.consequent, round(r.support, 9), round(r.confidence, 9), round(r.lift, 9))
            for r in rules.rules().collect() if r.antecedent.count(" + ") + 2 <= longest
        )

    assert rows(bounded, 3) == rows(whole, 3) != []
    assert sorted(bounded.pairs().collect()) == sorted(whole.pairs().collect())


def test_long_equal_baskets_stop_at_the_length(spark):
    # All subsets of thirty items are frequent: 2 ** 30 of them without the bound.
    df = spark.range(50).select(F.col("id").alias("basket"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n"))
    found = basket.mine(df.select("basket", F.format_string("i%02d", "n").alias("item")), 0.5, max_length=2)
    assert found.itemsets().count() == 30 + 435 and found.pairs().filter("baskets = 50").count() == 435


def test_nothing_and_one_item(spark):
    empty = spark.createDataFrame([], "basket long, item string")
    assert basket.mine(empty, 0.1, max_length=3).rules().collect() == []
    one = basket.mine(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "basket long, item string"), 0.5, max_length=3)
    assert [tuple(r) for r in one.itemsets().collect()] == [(["a"], 2)] and one.rules().collect() == []


def test_counts_of_a_block():
    items = np.array([2, 5, 9], np.int32)
    rows = np.array([[1, 1, 0, 1], [1, 0, 0, 1], [0, 1, 0, 1]], bool)
    bits = np.packbits(np.pad(rows, ((0, 0), (0, 60))), axis=1).view(np.uint64)
    sets = [(2,), (2, 5), (2, 5, 9), (2, 7), (2, 7, 9), (5, 9), (7, 9)]
    assert itemsets.counted(items, bits, sets).tolist() == [3, 2, 1, 0, 0, 1, 0]
