import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.fixtures import documents, odd_rows, prose
from tests.llm.test_op1 import base
from tests.llm.test_op3 import brute as brute_near
from tests.llm.test_op9 import brute as brute_hits
from waybill.llm import op5_quality
from waybill.llm.common import stage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    bench = [(1, prose(71, 30)), (2, "seldom seen")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    labels = [(k, int(k % 4 != 0), 0) for k in range(100, 300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    rows = odd_rows()
    for k in range(100, 300):
        text = prose(k, 60) if k % 4 else "&&& $$$ ### " * 40
        text += f" mail m{k}@example.com now" if k % 5 == 0 else ""
        text += " " + bench[0][1] if k % 7 == 0 else ""
        rows.append((k, text, "en", "src" + str(k % 3), len(text)))
    rows += [(k + 1000, r[1] + " again", *r[2:]) for k, r in enumerate(rows[-40:])]
    documents(spark, rows).write.parquet(f"{out}/documents.parquet")
    return out, rows, bench


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_stages_keep_columns_and_take_effect(spark, folder):
    out, rows, bench = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("score", F.lit("x"))
    text = {r[0]: r[1] for r in rows}
    for name, step in pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = stage(step(spark, docs, out), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "score"], name
        kept = ids(docs)
        given = [(r.doc_id, r.text) for r in before]
        if name == "near-duplicates":
            found = brute_near(given, pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT)
            assert kept == sorted({r[0] for r in found if r[3]}, key=repr)
        elif name == "benchmark decontamination":
            assert kept == sorted((r[1] for r in brute_hits(given, bench) if not r[0]), key=repr)
        elif name == "personal data":
            assert kept == sorted((d for d, _ in given), key=repr)
            for r in docs.collect():
                assert (r.text is None) == (text[r.doc_id] is None) and not base(r.text or "")
                assert r.text == text[r.doc_id] or len(r.text) == r.n_chars and "[EMAIL]" in r.text
        else:
            assert 0 < len(kept) < len(given)
    last = pipeline.STAGES[-1][1](spark, docs, out)
    assert {"size", "source_size", "target", "taken"} <= set(last.columns)
    assert all(0 < r.taken <= 3 * r.size for r in last.collect())


def test_quality_stage_leaves_what_the_classifier_accepts(spark, folder):
    out, _, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    scores = op5_quality.quality(docs, spark.read.parquet(f"{out}/labels.parquet")).collect()
    refused = {r.doc_id for r in scores if not r.predicted}
    kept = ids(pipeline.good_quality(spark, docs, out))
    assert kept == sorted((r.doc_id for r in scores if r.doc_id not in refused), key=repr)


def test_run_equals_the_stages(spark, folder):
    out, _, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    for _, step in pipeline.STAGES:
        docs = stage(step(spark, docs, out), "test")
    pick = ("doc_id", "text", "size", "target", "taken")
    assert sorted(map(repr, pipeline.run(spark, out).select(*pick).collect())) == sorted(map(repr, docs.select(*pick).collect()))


def test_empty_documents(spark, folder):
    out, _, _ = folder
    docs = documents(spark, [])
    for _, step in pipeline.STAGES:
        docs = step(spark, docs, out)
    assert docs.count() == 0
