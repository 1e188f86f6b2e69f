"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import op12_neighbours as op

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows, nearest=op.NEAREST, queries_of=op.QUERIES_OF):
    """{(query id, vector): [(vec_id, score), ...]} over distinct rows that take part."""
    kept = {(i, tuple(c + 0.0 for c in v)) for i, v, *_ in rows
            if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    lengths = [len(v) for _, v in kept]
    length = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = sorted(r for r in kept if len(r[1]) == length)
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    out = {}
    for k in np.flatnonzero(ids % queries_of == 0):
        scores = (x * x[k]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != k][:nearest]
        out.setdefault(int(ids[k]), []).append([(int(ids[j]), float(scores[j])) for j in order])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, wanted):
    assert got.keys() <= wanted.keys()
    hits = total = 0
    for query, (best,) in wanted.items():
        own = got.get(query, [])
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        scores = dict(best)
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in own if v in scores)
        hits += len({v for _, v, _ in own} & set(scores))
        total += len(best)
    return hits / total


@pytest.mark.parametrize("folder, least", [("sf0.01", 0.97), ("sf0.1", 0.93), ("check_s", 0.92)])
def test_recall_on_whole_tables(spark, folder, least):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding] if r.embedding is not None else None) for r in df.collect()]
    got, wanted = found(op.query(spark, f"/root/testdata/{folder}")), brute(rows)
    assert got.keys() == wanted.keys() and all(len(v) == op.NEAREST for v in got.values())
    assert recall(got, wanted) >= least


def clustered(n, dim, seed, lengths=False):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((40, dim)) * 3
    x = middle[rng.integers(40, size=n)] + rng.standard_normal((n, dim))
    x[: n // 3] = middle[0] + rng.standard_normal((n // 3, dim)) * 0.01  # a third near one place
    return x * (rng.lognormal(0, 1, (n, 1)) if lengths else 1)


@pytest.mark.parametrize("lengths", [False, True])
def test_clusters_a_hot_place_and_unequal_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(op, "BIN", 300)
    monkeypatch.setattr(op, "QUERY_BLOCK", 7)
    x = clustered(3000, 12, 5, lengths)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = found(op.neighbours(spark.createDataFrame(rows, KINDS).repartition(5)))
    assert recall(got, brute(rows)) >= 0.95


def test_many_exact_copies_are_all_right(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 8))
    rows = [(k, x[0].tolist() if k % 3 == 0 else x[k % 300].tolist(), 0) for k in range(900)]
    got = found(op.neighbours(spark.createDataFrame(rows, KINDS).repartition(4)))
    wanted = brute(rows)
    for query in got:  # the ties among copies go to the smallest ids
        if query % 3 == 0:
            top = [v for _, v, s in got[query] if abs(s - wanted[query][0][0][1]) < 1e-12]
            assert top == [v for v, s in wanted[query][0] if abs(s - wanted[query][0][0][1]) < 1e-12]
    assert recall(got, wanted) >= 0.95


@pytest.mark.parametrize("parts", [1, 6])
def test_odd_rows_equal_brute_force(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-2, 3, 5).astype(float).tolist(), 0) for k in range(-40, 60)]
    rows += [rows[3], rows[3], (20, [9.0, 0.0, 0.0, 0.0, 1.0], None), (None, [1.0] * 5, 0), (200, None, 0), (220, [], 0)]
    rows += [(240, [0.0] * 5, 0), (260, [1.0, None, 0.0, 0.0, 0.0], 0), (280, [float("nan")] * 5, 0), (300, [1.0, 2.0], 0)]
    rows += [(320, [-0.0, 0.0, 1e-300, 0.0, 0.0], 1), (340, [1e150, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, KINDS).repartition(parts)
    df = df.select("*", *(F.lit(1).alias(c) for c in ("raw", "cls", "query", "rank", "score", "list", "key", "i", "first", "ids")))
    got = {}
    for r in sorted(op.neighbours(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = brute(rows)
    assert got.keys() == wanted.keys()
    for query, lists in wanted.items():
        if len(lists) == 1:
            assert got[query] == lists[0]
        else:
            assert sorted(got[query]) == sorted(r for one in lists for r in one)


def test_few_rows_and_none(spark):
    empty = spark.createDataFrame([], KINDS)
    assert op.neighbours(empty).collect() == []
    assert op.neighbours(spark.createDataFrame([(0, [1.0], 0)], KINDS)).collect() == []
    rows = op.neighbours(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [-1.0], 0)], KINDS)).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, 1, 2.0), (0, 2, 2, -1.0)]


def test_graph_finds_what_all_distances_find():
    x = clustered(6000, 16, 3).astype(np.float32)
    centres = op.Centres(x, 500)
    rows, lists, far = centres.near(x[::20], 0.3)
    all_ = np.linalg.norm(x[::20, None, :] - centres.c, axis=2)
    wanted = all_ <= all_.min(axis=1, keepdims=True) * 1.3
    got = np.zeros_like(wanted)
    got[rows, lists] = True
    assert (got & wanted).sum() >= 0.98 * wanted.sum() and np.allclose(far, all_[rows, lists], rtol=1e-4)


def test_lists_are_balanced_and_bins_bounded():
    parts = op.halved(clustered(5000, 6, 1), 37)
    assert max(map(len, parts)) - min(map(len, parts)) <= 12 and sum(map(len, parts)) == 5000
    counts = np.array([10, 20, 950, 5, 90, 100, 3])
    bins = op.Bins(counts, 100)
    load = {}
    for first, n, k in zip(bins.first, bins.parts, counts):
        for part in range(n):
            load[first + part] = load.get(first + part, 0) + k / n
    assert max(load.values()) <= 100 and bins.parts.tolist() == [1, 1, 10, 1, 1, 1, 1]
