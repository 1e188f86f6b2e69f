"""Training table, model and market-basket rules."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.micro import by, sources
from waybill.plans import basket, risk


def test_training_rows(spark):
    src = sources(
        spark,
        orders=[
            ("o", "c", "delivered", "2018-01-01 06:00:00", "2018-01-20 00:00:00", "2018-01-11 18:00:00"),
            ("p", "d", "delivered", "2018-01-02 00:00:00", None, "2018-01-11 00:00:00"),
            ("q", "c", "shipped", "2018-01-02 00:00:00", None, None),
        ],
        customers=[("c", "SP"), ("d", None)],
        payments=[("o", 1, "card", 3, 5), ("o", 2, "voucher", None, 5)],
        items=[("o", 1, "x", "s1", 1, 1.1), ("o", 2, "y", "s2", 1, 2.2), ("o", 3, "x", "s2", 1, None), ("o", 4, "z", "s1", 1, 1), ("o", 5, "x", "s3", 1, 0)],
        products=[("x", 500, 10, 10, 10), ("y", None, 20, None, 10)],
        sellers=[("s1", "SP"), ("s2", "MG"), ("s3", None)],
    )
    rows = risk.training_table(src, keep_keys=True).orderBy("order_id", "payment_sequential").collect()
    assert [(r.order_id, r.payment_type, r.payment_installments) for r in rows] == [("o", "card", 3), ("o", "voucher", 1), ("p", None, 1)]
    o, _, p = rows
    assert (o.weekday, o.hour, o.promised_days, o.items_cnt, o.freight_value) == (0, 6, 10.5, 5, 4.3)
    assert (o.total_weight_kg, o.total_volume_dm3) == (1.5, 3.0)
    # MG and SP both twice: the smaller code wins, so buyer and seller differ.
    assert (o.seller_state, o.same_state, o.late) == ("MG", 0, 1)
    assert (p.items_cnt, p.freight_value, p.total_weight_kg, p.seller_state, p.same_state, p.late) == (1, 0.0, 0.0, None, 0, 0)


def planted(spark, n=4000):
    """Late orders follow the promised days and one payment type."""
    draw = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    days = (F.col("id") % 20).cast("double")
    slow = F.col("id") % 3 == 0
    logit = (10 - days) / 4 + F.when(slow, 1.5).otherwise(-1.0)
    return spark.range(n).select(
        F.col("id").alias("order_id"), F.lit(1).alias("payment_sequential"),
        (F.col("id") % 7).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"),
        days.alias("promised_days"), F.lit(1).cast("long").alias("items_cnt"), (F.col("id") % 11).cast("double").alias("freight_value"),
        F.lit(1.0).alias("total_weight_kg"), F.lit(2.0).alias("total_volume_dm3"), F.lit(1).alias("payment_installments"),
        F.lit(0).alias("same_state"), F.when(slow, "slow").when(F.col("id") % 3 == 1, "card").alias("payment_type"),
        F.lit("SP").alias("customer_state"), F.lit("RJ").alias("seller_state"),
        (draw < 1 / (1 + F.exp(-logit))).cast("int").alias("late"),
    )


@pytest.fixture(scope="module")
def fitted(spark):
    parts = risk.split(planted(spark)).cache()
    yield parts, risk.fit(parts.filter(~F.col("is_test")))
    parts.unpersist()


def test_model_finds_the_planted_signal(spark, fitted):
    parts, model = fitted
    scored = model.score(parts.filter("is_test"))
    row = risk.quality(scored).first()
    assert row.auc > 0.75
    assert row.true_on_time + row.false_late + row.false_on_time + row.true_late == 800
    coefs = {r.feature: r.coef for r in model.coefficients(spark).collect()}
    assert coefs["promised_days"] < 0
    assert coefs["payment_type=slow"] > coefs["payment_type=card"]
    assert "payment_type=__null__" in coefs
    top = model.top_features(spark, 3).collect()
    assert [abs(r.coef) for r in top] == sorted((abs(c) for c in coefs.values()), reverse=True)[:3]
    assert risk.test_summary(scored).first().rows == 800


def test_unseen_category_adds_nothing(spark, fitted):
    parts, model = fitted
    row = parts.limit(1).withColumn("payment_type", F.lit("new"))
    coefs = {r.feature: r.coef for r in model.coefficients(spark).collect()}
    known = model.score(row.withColumn("payment_type", F.lit("card"))).first().risk
    unseen = model.score(row).first().risk
    logit = lambda p: np.log(p / (1 - p))
    assert logit(known) - logit(unseen) == pytest.approx(coefs["payment_type=card"], abs=1e-6)


def test_model_minimises_the_balanced_penalised_loss(fitted):
    """Newton's method on the textbook objective reaches the same coefficients."""
    parts, model = fitted
    train = parts.filter(~F.col("is_test")).fillna(risk.MISSING, subset=risk.CATEGORICAL).toPandas()
    columns = []
    for name in model.feature_names():
        column, _, value = name.partition("=")
        columns.append((train[column] == value).astype(float) if value else train[column].astype(float))
    x = np.column_stack([*columns, np.ones(len(train))])
    y = train.late.to_numpy(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.ones(x.shape[1])
    penalty[-1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        beta -= np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    # Constant columns share their effect with the intercept; compare the others.
    varying = [i for i in range(x.shape[1] - 1) if x[:, i].std() > 0]
    assert np.allclose(model.regression.coefficients.toArray()[varying], beta[varying], atol=2e-3)


def test_the_split_table_is_joined_once(spark):
    """What reads the split scans staged rows, without the joins that made the table."""
    table = planted(spark, 200).join(spark.range(200).withColumnRenamed("id", "order_id"), "order_id")
    parts = risk.split(table)
    assert all("/training-" in f for f in parts.inputFiles()) and parts.inputFiles()
    assert sorted(map(tuple, parts.drop("is_test").collect())) == sorted(map(tuple, table.select(parts.drop("is_test").columns).collect()))


def test_slopes_equal_sums_over_all_rows(fitted):
    """Also where a category of the model has no row, and away from the minimum."""
    parts, model = fitted
    some = parts.filter("order_id % 3 <> 1 AND order_id % 5 <> 2")
    rows = model.score(some).fillna(risk.MISSING, subset=risk.CATEGORICAL).toPandas()
    late = rows.late.to_numpy(float)
    w = np.where(late == 1, len(rows) / (2 * late.sum()), len(rows) / (2 * (1 - late).sum()))
    found = {r.feature: r.slope for r in risk.loss_gradient(model, some, c=0.5).collect()}
    assert [*found] == model.feature_names() and "payment_type=card" in found
    for name, weight in model.weights().items():
        column, _, value = name.partition("=")
        x = (rows[column] == value if value else rows[column]).to_numpy(float)
        slope = ((w * (rows.risk - late) * x).sum() + weight / 0.5) / w.sum() / (x.std() or 1.0)
        assert found[name] == pytest.approx(slope, abs=1e-9)


def test_scoring_keeps_rows_and_columns(spark, fitted):
    parts, model = fitted
    test = parts.filter("is_test").withColumn("order_no", F.monotonically_increasing_id())
    gaps = test.withColumn("promised_days", F.when(F.col("order_no") % 2 == 0, F.col("promised_days"))).withColumn(
        "hour", F.when(F.col("order_no") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("hour").cast("double"))
    ).withColumn("payment_type", F.when(F.col("order_no") % 3 == 0, F.col("payment_type")))
    gaps = gaps.cache()
    scored = model.score(gaps)
    assert scored.columns == [*gaps.columns, "risk"]
    before, after = ({r.order_no: r for r in df.collect()} for df in (gaps, scored))
    assert len(before) == len(after) and before.keys() == after.keys()
    for k, row in after.items():
        missing = row.promised_days is None or row.hour != row.hour
        assert (row.risk is None) == missing and row.payment_type == before[k].payment_type
    assert risk.fit(gaps, max_iter=1).left_out == sum(r.risk is None for r in after.values())


def test_basket_rules_equal_brute_force(spark):
    baskets = {b: {i for i in range(8) if (b * (i + 3)) % 7 < 3} for b in range(60)}
    lines = [(b, f"i{i}") for b, items in baskets.items() for i in items for _ in range(2)] + [(b, "rare") for b in (1, 2)]
    rules = basket.mine(spark.createDataFrame(lines, "basket int, item string"), min_support=0.2)
    total = len({b for b, _ in lines})
    holding = lambda s: sum(s <= {f"i{i}" for i in items} for items in baskets.values())
    pairs = {
        (a, b): holding({a, b})
        for a, b in combinations([f"i{i}" for i in range(8)], 2) if holding({a, b}) >= 0.2 * total
    }
    assert {(r.item_a, r.item_b): r.baskets for r in rules.pairs().collect()} == pairs
    for r in rules.rules().filter(~F.col("antecedent").contains("+")).collect():
        both, first, second = holding({r.antecedent, r.consequent}), holding({r.antecedent}), holding({r.consequent})
        assert r.support == pytest.approx(both / total) and r.confidence == pytest.approx(both / first)
        assert r.lift == pytest.approx(both / first / (second / total))
    assert not any("rare" in r["items"] for r in rules.itemsets().collect())


def test_one_huge_basket_is_bounded_by_the_frequent_items(spark):
    lines = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 100).alias("basket"),
        F.when(F.col("id") % 4 < 2, F.concat(F.lit("u"), "id")).otherwise(F.concat(F.lit("f"), F.col("id") % 3)).alias("item"),
    )
    sets = by(basket.transactions(lines, 0.2), "basket")
    assert max(len(v["items"]) for v in sets.values()) <= 3
    assert len(sets) == lines.select("basket").distinct().count()
