"""Order statistics by counting."""

import random

import pytest
from pyspark.sql import functions as F

from waybill.operators.cuts import cuts
from waybill.operators.topk import newest, oldest


def rows(seed):
    rng = random.Random(seed)
    texts = ["", "a", "a\0", "ab", "order-000001", "order-000002", "order-000002x", "é", "漢字", "z" * 30, "z" * 31]
    return [
        (rng.choice(["p", "q", None]), rng.choice([0.0, -1.5, 2.5, 1e300, 1e-9, rng.random()]), rng.choice(texts), k)
        for k in range(300)
    ]


@pytest.mark.parametrize("order", [["v", "id"], ["v", "t", "id"], ["t", "v", "id"], ["id"]])
def test_cuts_equal_a_sort(spark, order):
    data = rows(1)
    df = spark.createDataFrame(data, "g string, v double, t string, id long").repartition(5)
    found = cuts(df, order, lambda n: [1, n // 3, n // 2, n], group=["g"])
    for key in {r[0] for r in data}:
        own = [dict(zip("gvt", r[:3], strict=True)) | {"id": r[3]} for r in data if r[0] == key]
        own.sort(key=lambda r: [r[c].encode() if c == "t" else r[c] for c in order])
        n, places = found[(key,)]
        assert n == len(own) and set(places) == {1, n // 3, n // 2, n}
        for place, cut in places.items():
            here = df.filter(F.col("g").eqNullSafe(key)).filter(cut.at_or_after())
            assert sorted(r.id for r in here.collect()) == sorted(r["id"] for r in own[place - 1 :])


def test_equal_rows_share_a_cut(spark):
    df = spark.createDataFrame([(1, "x")] * 10 + [(2, "y")] * 5 + [(None, "z")], "a int, b string")
    n, places = cuts(df, ["a", "b"], lambda n: [3, 10, 11])[()]
    assert n == 15
    assert [df.filter(places[p].at_or_after()).count() for p in (3, 10, 11)] == [15, 15, 5]
    assert cuts(df.filter("a > 5"), ["a"], lambda n: [1]) == {}


def test_limits_keep_exactly_n(spark):
    rng = random.Random(2)
    data = [(f"o{k:05d}", rng.choice([None, 1_500_000_000 + rng.randrange(40)])) for k in range(400)]
    df = spark.createDataFrame(data, "order_id string, s long").withColumn("order_purchase_timestamp", F.timestamp_seconds("s"))
    latest = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]), reverse=True)
    earliest = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    for n in (1, 57, 130, 250, 399, 400, 1000):
        assert {r.order_id for r in newest(df, n).collect()} == {r[0] for r in latest[:n]}
        assert {r.order_id for r in oldest(df, n).collect()} == {r[0] for r in earliest[:n]}
    assert newest(df.filter("s = 0"), 5).count() == 0
