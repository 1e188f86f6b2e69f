import zlib

import numpy as np
import pyarrow.parquet as pq

from tests.llm.fixtures import SMALL, documents, odd_rows, prose
from waybill.llm import op5_quality as op


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op.query(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    held = [d for d in labels if d in found and found[d].held_out]
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in found)
    assert auc([found[d].score for d in held], [labels[d] for d in held]) > 0.9
    assert np.mean([found[d].predicted == labels[d] for d in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_pooling_is_the_best_rising_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 9)
        y, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        places, levels = op.pooled(np.arange(n, dtype=float), y * w, w)
        assert (np.diff(levels) >= 0).all() and (np.diff(places) > 0).all()
        # The minimax formula of isotonic regression.
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        best = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(best, 9))), np.round(levels, 9))


def test_equations_equal_one_matrix_product(spark):
    df = documents(spark, [(k, f"Some words {'no ' * (k % 9)} {k}", "en", "a", 1) for k in range(200)])
    labels = spark.createDataFrame([(k, k % 3 % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    features = op.measured(df)
    kernel = op.fit(features, labels)
    rows = features.toPandas()
    rows = rows[[zlib.crc32(str(d).encode()) % 5 != 0 for d in rows.doc_id]]
    z, y = kernel.features(rows[op.NAMES].to_numpy()), (rows.doc_id % 3 % 2).to_numpy()
    right = np.linalg.solve(z.T @ z + (op.RIDGE * len(y) + 1e-6) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(kernel.weights, right, atol=1e-5)


def test_odd_rows_and_labels(spark):
    rows = odd_rows()
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (7, 1, 1), (7, 1, 1), (10, 0, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    found = op.quality(documents(spark, rows, clashing=True), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    same = {r.score for r in found if r.doc_id in (10, 11)}
    assert len(same) == 1


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.quality(documents(spark, []), labels).count() == 0
    assert {r.score for r in op.quality(documents(spark, odd_rows()), labels).collect()} == {0.5}


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(k, prose(k, 40) if k % 3 else "$$ ## " * 30, "en", "a", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    found = []
    for parts in (1, 40):
        df = documents(spark, rows).repartition(parts)
        found.append({r.doc_id: r.score for r in op.quality(df, labels).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-6 for k in found[0])
