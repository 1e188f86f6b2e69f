"""From raw documents to a training mix: five stages, each on what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next one.  All but the last return the columns of the
documents they were given, in their order.  What a stage decides is kept as a narrow
table of ids; everything else it staged is deleted before it returns.

Defined results: rows without id pass every stage but the personal data, which are
replaced in them too.  Null and empty texts are scored as empty texts, have no near
duplicates, no passage and nothing to replace, and the mix takes nothing of them.  If an
id repeats, a refusal of one of its rows refuses all of them; of rows of one id that all
stay, the near-duplicate stage keeps the one whose text has the least digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm import op1_pii, op3_near_duplicates, op5_quality, op7_mix, op9_decontaminate
from waybill.llm.common import small_batches, table
from waybill.session import delete_path, scratch_path, scratch_scope

# Near duplicates are documents that share four fifths of their runs of five words.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def _without(docs: DataFrame, refused: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is refused; rows without id stay."""
    return docs.join(refused.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the quality classifier rejects."""
    with scratch_scope(spark) as keep, small_batches(spark):
        scores = op5_quality.quality(docs, table(spark, sf_dir, "labels"))
        refused = keep(scores.filter("predicted = 0").select("doc_id"), "poor")
    return _without(docs, refused)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, and one row of its id."""
    with scratch_scope(spark) as keep, small_batches(spark):
        found = keep(op3_near_duplicates.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT), "found")
    kept = _without(docs, found.filter("NOT kept"))
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    # The same row whatever the order they come in; equal digests are equal rows.
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))), 256)
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), digest).alias("_row")
    )
    return _without(kept, repeated).unionByName(again.select("_row.*").select(docs.columns))


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark passage."""
    with scratch_scope(spark) as keep, small_batches(spark):
        found = op9_decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
        refused = keep(found.filter("contaminated").select("doc_id"), "contaminated")
    return _without(docs, refused)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; the character count follows the text."""
    clean = op1_pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", length.cast(kind)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: of each document its whole rounds and its chosen blocks.

    The text is cut or repeated so that it holds ``taken`` words; the character count
    follows it, size is that of the whole text.  A column of the documents named size,
    source_size, target, taken, rounds or spans is replaced.
    """
    found = op7_mix.mix(docs.withColumn("size", op7_mix.size_of(F.col("text"))), spans=True).filter("taken > 0")
    found = found.withColumn("text", op7_mix.cut_text(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", not_contaminated),
    ("personal data", no_personal_data),
    ("mixing", mixed),
]

# The classifier, the posterior pruning and the expansion of anchors are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each output goes once the next is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        before, path = path, scratch_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
