"""Late-delivery risk: training table, model, scores and their quality."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from waybill.functions.casts import flag, to_number
from waybill.functions.money import money_sum
from waybill.functions.timing import days_between, late_label, monday_first
from waybill.operators.classification import (
    confusion_matrix,
    predict_class,
    roc_auc,
    stratified_split,
    with_class_weight,
)
from waybill.operators.filters import is_complete, with_status
from waybill.operators.skew import left_join_apart
from waybill.operators.topk import oldest, top
from waybill.plans.facts import payments_per_order
from waybill.session import stage
from waybill.sources.tables import Sources

# The model's numbers and categories, in this order.
NUMERIC = [
    "weekday", "hour", "promised_days", "items_cnt", "freight_value", "total_weight_kg",
    "total_volume_dm3", "payment_installments", "same_state",
]
CATEGORICAL = ["payment_type", "customer_state", "seller_state"]
LABEL = "late"
# Together unique in the training table.
KEYS = ["order_id", "payment_sequential"]
MISSING = "__null__"


def item_features(src: Sources) -> DataFrame:
    """Count, freight, weight, volume and commonest seller state per order.

    Items are first combined per order and seller state, which both counts the
    states and carries the sums along, so one scan and one chain of joins serve
    all features.  Ties between states go to the smallest code.
    """
    # Summed in grams and cubic centimetres: whole numbers add up exactly.
    grams = F.coalesce("product_weight_g", F.lit(0.0))
    volume = (
        F.coalesce("product_length_cm", F.lit(0.0))
        * F.coalesce("product_height_cm", F.lit(0.0))
        * F.coalesce("product_width_cm", F.lit(0.0))
    )
    per_state = (
        src.items.select("order_id", "product_id", "seller_id", "freight_value")
        .join(src.products, "product_id", "left")
        .join(src.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .groupBy("order_id", "seller_state")
        .agg(
            F.count("product_id").alias("items"),
            F.count(F.lit(1)).alias("rows"),
            money_sum(F.col("freight_value")).alias("freight"),
            F.sum(grams).alias("grams"),
            F.sum(volume).alias("volume"),
        )
    )
    commonest = F.min(
        F.when(
            F.col("seller_state").isNotNull(),
            F.struct((-F.col("rows")).alias("rank"), "seller_state"),
        )
    )
    return per_state.groupBy("order_id").agg(
        F.sum("items").alias("items_cnt"),
        money_sum(F.col("freight")).alias("freight_value"),
        (F.sum("grams") / 1000).alias("total_weight_kg"),
        (F.sum("volume") / 1000).alias("total_volume_dm3"),
        commonest.getField("seller_state").alias("seller_state"),
    )


def training_table(
    src: Sources, max_orders: int | None = None, payment_mode: str = "fanout", keep_keys: bool = False
) -> DataFrame:
    """Features known at purchase time and the label, for delivered orders.

    Payments join one by one, so an order with two payments gives two rows;
    ``payment_mode="first"`` gives one row per order, with its first known
    payment type and its longest instalment plan.  ``max_orders`` keeps the
    oldest orders.
    """
    if payment_mode not in ("fanout", "first"):
        raise ValueError("payment_mode is 'fanout' or 'first'")
    bought = F.col("order_purchase_timestamp")
    promised = F.col("order_estimated_delivery_date")
    orders = oldest(with_status(src.orders, "delivered"), max_orders).select(
        "order_id",
        "customer_id",
        late_label(F.col("order_delivered_customer_date"), promised).alias(LABEL),
        monday_first(bought).alias("weekday"),
        F.hour(bought).alias("hour"),
        days_between(bought, promised).alias("promised_days"),
    )
    joined = (
        orders.join(src.customers.select("customer_id", "customer_state"), "customer_id", "left")
        .join(item_features(src), "order_id", "left")
    )
    if payment_mode == "first":
        payments = payments_per_order(src.payments).select(
            "order_id", F.lit(1).alias("payment_sequential"), "payment_type",
            F.col("installments").alias("payment_installments"),
        )
        full = joined.join(payments, "order_id", "left")
    else:
        payments = src.payments.select(
            "order_id", "payment_sequential", "payment_type", "payment_installments"
        )
        full = left_join_apart(joined, payments, "order_id", src.hot_orders("payments"))
    features = {
        "same_state": flag(F.col("customer_state") == F.col("seller_state")),
        "items_cnt": F.coalesce("items_cnt", F.lit(1)),
        "freight_value": F.coalesce("freight_value", F.lit(0.0)),
        "total_weight_kg": F.coalesce("total_weight_kg", F.lit(0.0)),
        "total_volume_dm3": F.coalesce("total_volume_dm3", F.lit(0.0)),
        "payment_installments": F.coalesce("payment_installments", F.lit(1)),
        "payment_sequential": F.coalesce("payment_sequential", F.lit(0)),
    }
    keys = KEYS if keep_keys else []
    return full.withColumns(features).select(*keys, *NUMERIC, *CATEGORICAL, LABEL)


def split(table: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``training_table(keep_keys=True)`` with ``is_test``.

    The split, the fit and their measures read the table many times, so it is staged and
    its joins run once.
    """
    return stratified_split(stage(table, "training"), KEYS, LABEL, test_share, seed)


# The names that encoded copies of the categories bear inside the encoder.
_COPY = "_risk_{}"
_COPIES = [_COPY.format(name) for name in CATEGORICAL]


def _copied(df: DataFrame) -> DataFrame:
    """Copies of the categories, a missing one being a category of its own."""
    return df.withColumns(
        {_COPY.format(name): F.coalesce(F.col(name).cast("string"), F.lit(MISSING)) for name in CATEGORICAL}
    )


def linear_score(weights: Mapping[str, float]) -> Column:
    """Sum of the weights of a row's features, named ``column`` or ``column=category``.

    An unseen category adds nothing.  A row that lacks a number has no score: null.
    """
    total = F.lit(0.0)
    for name in NUMERIC:
        total = total + F.lit(float(weights.get(name, 0.0))) * to_number(F.col(name))
    for name in CATEGORICAL:
        known = {k.partition("=")[2]: w for k, w in weights.items() if k.startswith(f"{name}=")}
        if known:
            pairs = (F.lit(x) for value, w in known.items() for x in (value, float(w)))
            category = F.coalesce(F.col(name).cast("string"), F.lit(MISSING))
            total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(0.0))
    return total


def probability(score: Column) -> Column:
    """The logistic function, without overflow at either end."""
    small = F.exp(-F.abs(score))
    return F.when(score >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def scored_by(df: DataFrame, weights: Mapping[str, float], intercept: float) -> DataFrame:
    """Add ``risk`` from given weights; all rows and columns stay as they are."""
    return df.withColumn("risk", probability(linear_score(weights) + F.lit(float(intercept))))


def top_weights(coefficients: DataFrame, k: int = 20) -> DataFrame:
    """The features with the largest coefficients, either sign."""
    return top(coefficients, k, F.desc(F.abs("coef")), F.col("feature"))


def fit_encoder(rows: DataFrame) -> PipelineModel:
    """One-hot categories and unscaled numbers as ``features``.

    An unseen category encodes to all zeros.
    """
    indexed = [f"{name}_ix" for name in _COPIES]
    encoded = [f"{name}_oh" for name in _COPIES]
    encoding = Pipeline(
        stages=[
            StringIndexer(
                inputCols=_COPIES, outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            VectorAssembler(inputCols=[*encoded, *NUMERIC], outputCol="features"),
        ]
    )
    return encoding.fit(_copied(rows))


def encode(encoder: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``features``."""
    return encoder.transform(_copied(rows)).select(*rows.columns, "features")


def feature_names(encoder: PipelineModel) -> list[str]:
    """``column=category`` for the encoded categories, then the numbers."""
    labels = zip(CATEGORICAL, encoder.stages[0].labelsArray, strict=True)
    return [f"{column}={value}" for column, known in labels for value in known] + NUMERIC


@dataclass
class RiskModel:
    """A fitted model.  ``left_out`` is the number of training rows without a number
    in some column; the fit cannot use them."""

    encoder: PipelineModel
    regression: LogisticRegressionModel
    left_out: int = 0

    def feature_names(self) -> list[str]:
        return feature_names(self.encoder)

    def weights(self) -> dict[str, float]:
        return dict(zip(self.feature_names(), map(float, self.regression.coefficients.toArray()), strict=True))

    def coefficients(self, spark) -> DataFrame:
        """Feature and coefficient, one row per feature."""
        return spark.createDataFrame(list(self.weights().items()), "feature string, coef double")

    def top_features(self, spark, k: int = 20) -> DataFrame:
        return top_weights(self.coefficients(spark), k)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk``, the probability of a late delivery; null where a number is missing."""
        return scored_by(df, self.weights(), self.regression.intercept)


def fit(train: DataFrame, max_iter: int = 1000, c: float = 1.0) -> RiskModel:
    """L2 logistic regression on one-hot categories and unscaled numbers.

    Classes are weighted to balance.  Spark averages the loss over the weights
    where the usual objective sums it, so the penalty is 1 / (C * sum of weights).
    Rows without a number in some column are left out and counted in the model.
    """
    # Read once per category and by the regression, which makes and keeps blocks of
    # vectors for its iterations itself.  A lost block is computed again from the staged
    # rows, with the same result.
    marked = train.withColumn("_complete", is_complete(*NUMERIC)).persist(StorageLevel.MEMORY_AND_DISK)
    left_out = marked.filter(~F.col("_complete")).count()
    rows = marked.filter("_complete")
    encoder = fit_encoder(rows)
    weighted = with_class_weight(rows, LABEL)
    vectors = encode(encoder, weighted).select("features", LABEL, "weight")
    try:
        weight_sum = weighted.agg(F.sum("weight")).first()[0]
        model = LogisticRegression(
            labelCol=LABEL, weightCol="weight", regParam=1.0 / (c * weight_sum),
            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
        ).fit(vectors)
    finally:
        marked.unpersist()
    return RiskModel(encoder, model, left_out)


def loss_gradient(model: RiskModel, train: DataFrame, c: float = 1.0) -> DataFrame:
    """Per feature the slope of the penalised loss at the fitted weights.

    It is taken per unit of weight and standard deviation of the feature, in one pass
    over the rows for the numbers and one for the categories; at the minimum it is 0.
    """
    rows = with_class_weight(train.filter(is_complete(*NUMERIC)), LABEL)
    error = F.col("weight") * (F.col("risk") - F.col(LABEL))
    scored = _copied(model.score(rows).withColumn("_error", error))
    sums = [f.alias(f"{name}_{part}") for name in NUMERIC for part, f in (
        ("g", F.sum(F.col("_error") * F.col(name).cast("double"))), ("s", F.stddev_pop(F.col(name).cast("double"))))]
    row = scored.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *sums).first()
    found = {name: (row[f"{name}_g"], row[f"{name}_s"]) for name in NUMERIC}
    # Rows are combined per combination of categories before each counts for three.
    combined = scored.groupBy(*_COPIES).agg(F.sum("_error").alias("g"), F.count(F.lit(1)).alias("n"))
    features = (F.concat(F.lit(f"{name}="), _COPY.format(name)) for name in CATEGORICAL)
    for r in combined.select(F.explode(F.array(*features)).alias("feature"), "g", "n").groupBy("feature").agg(
        F.sum("g").alias("g"), F.sum("n").alias("n")
    ).filter(F.col("feature").isin(model.feature_names())).collect():  # at most a row for each feature
        share = r.n / row["n"]
        found[r.feature] = (r.g, (share * (1 - share)) ** 0.5)
    slopes = []
    for name, weight in model.weights().items():
        g, s = found.get(name, (0.0, 0.0))
        slopes.append((name, (g + weight / c) / row["w"] / (s or 1.0)))
    return train.sparkSession.createDataFrame(slopes, "feature string, slope double")


def test_summary(df: DataFrame) -> DataFrame:
    """Rows and share of late ones."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), (100 * F.avg(LABEL)).alias("late_pct")
    )


def quality(scored: DataFrame, score: str = "risk", threshold: float = 0.5) -> DataFrame:
    """One row: ROC-AUC and the confusion counts at a threshold.

    Both are one-row results; the second enters as a subquery.
    """
    matrix = confusion_matrix(
        scored.withColumn("_class", predict_class(F.col(score), threshold)), LABEL, "_class"
    )
    return (
        roc_auc(scored, LABEL, score)
        .withColumn("_m", matrix.select(F.struct("*")).scalar())
        .select("auc", "_m.*")
    )
