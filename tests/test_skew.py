"""A key that holds a large share of the rows."""

from pyspark.sql import functions as F

from tests.micro import sources
from waybill.operators.skew import frequent_keys, left_join_apart
from waybill.plans.facts import build_facts


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def sides(spark):
    left = spark.range(60).select(
        F.when(F.col("id") < 50, F.col("id")).alias("k"), (F.col("id") * 2).alias("a")
    )
    right = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("b"),
    )
    return left, right


def test_frequent_keys_are_found_and_few(spark):
    _, right = sides(spark)
    found = frequent_keys(right, "k", tasks=2, rows=100)
    assert list(found) == [7] and 2 <= found[7] <= 8
    assert frequent_keys(right, "k") == {}
    assert len(frequent_keys(right, "k", tasks=0.1, rows=1)) <= 80
    assert frequent_keys(right.filter("b < 0"), "k") == {}
    assert frequent_keys(right.filter("k IS NULL"), "k") == {}
    many = right.repartition(300)
    assert list(frequent_keys(many.withColumn("k", F.col("k").cast("string")), "k", tasks=2, rows=100)) == ["7"]


def test_joining_apart_equals_the_plain_join(spark):
    left, right = sides(spark)
    plain = rows(left.join(right, "k", "left"))
    for hot in ({}, {7: 4}, {7: 8, 3: 2}, {7: 1}, {7: 5000}):
        assert rows(left_join_apart(left, right, "k", hot)) == plain


def test_hot_order_in_the_facts(spark):
    orders = [(str(i), "c", "delivered", "2018-01-01 00:00:00", None, None) for i in range(10)]
    reviews = [("3", i % 5 + 1) for i in range(50)] + [("1", 4)]
    plain = sources(spark, orders=orders, reviews=reviews)
    apart = sources(spark, orders=orders, reviews=reviews)
    plain.hot_keys["reviews"] = {}
    apart.hot_keys["reviews"] = {"3": 4, "1": 2}
    assert rows(build_facts(apart)) == rows(build_facts(plain))
    assert build_facts(apart).count() == 50 + 1 + 8


def test_a_frequent_key_is_spread_and_read_once(spark, tmp_path, capsys):
    left, right = sides(spark)
    for name, df in (("l", left), ("r", right)):
        df.write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / name)) for name in ("l", "r"))
    joined = left_join_apart(left, right, "k", {7: 8}).select("k", "a", "b")
    joined.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = left_join_apart(left, right, "k", {7: 64}).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 1000  # the key alone has over 1000 rows
