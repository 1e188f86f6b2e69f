"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SMALL
from waybill.llm import op11_whitening as op

KINDS = "vec_id long, embedding array<double>, label int"


def dense(x):
    """Eigenvalues and eigenvectors of the covariance, the largest first."""
    apart = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(apart.T @ apart / len(x))
    return values[::-1], vectors[:, ::-1]


def cases():
    rng = np.random.default_rng(11)
    yield rng.standard_normal((200, 12)) @ rng.standard_normal((12, 12)) * 300
    yield np.repeat(rng.standard_normal((4, 9)), 20, axis=0) * 500
    yield rng.standard_normal((5, 16)) * 100
    yield np.eye(10).repeat(6, axis=0) * 700
    yield np.hstack([rng.standard_normal((80, 3)) * 1e4, rng.standard_normal((80, 3)) * 1e-3, np.ones((80, 2))])


@pytest.mark.parametrize("case", range(5))
def test_updates_and_merges_equal_the_dense_form(case):
    x = list(cases())[case]
    whole = op.Spectrum(x.shape[1])
    for row in x:
        whole.add(row)
    parts = []
    for piece in np.array_split(x, 4):
        parts.append(op.Spectrum(x.shape[1]))
        for row in piece:
            parts[-1].add(row)
    for other in parts[1:]:
        parts[0].merge(op.Spectrum.unpack(other.pack(), x.shape[1]))
    apart = x - x.mean(axis=0)
    wanted = apart.T @ apart
    for found in (whole, parts[0]):
        assert found.n == len(x) and np.allclose(found.mean, x.mean(axis=0), atol=1e-9)
        size = np.abs(wanted).max()
        assert np.abs((found.vectors * found.values) @ found.vectors.T - wanted).max() < 1e-11 * size
        assert np.abs(found.vectors.T @ found.vectors - np.eye(len(wanted))).max() < 1e-12
        assert np.allclose(found.values, np.linalg.eigvalsh(wanted), atol=1e-11 * size)


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(3)
    for k in (2, 3, 7, 40):
        for spread in (1e-9, 1.0, 1e6):
            d = np.sort(rng.random(k)) * spread + rng.random(k).cumsum() * 1e-6
            z = rng.standard_normal(k)
            z /= np.sqrt(z @ z)
            roots, turn = op.secular(d, z, 2.5)
            matrix = np.diag(d) + 2.5 * np.outer(z, z)
            assert np.allclose(roots, np.linalg.eigvalsh(matrix), rtol=1e-12, atol=1e-13 * max(spread, 1))
            assert np.abs(turn.T @ turn - np.eye(k)).max() < 1e-13
            assert np.abs(matrix @ turn - turn * roots).max() < 1e-12 * max(spread, 1)


def brute(rows, components=op.COMPONENTS):
    kept = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    length = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in kept if len(v) == length]
    n, sums = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    x = np.array([v for _, v in kept], float)
    values, vectors = dense(x)
    out = {}
    for (i, v), row in zip(kept, (x - x.mean(axis=0)) @ vectors):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k in range(min(components, length)):
            live = values[k] > 1e-9 * values.sum()
            out.setdefault((i, k + 1), []).append((deviation, abs(row[k]) / math.sqrt(values[k]) if live else 0, values[k] / values.sum() if live else 0))
    return n, out


def compare(got, rows):
    n, wanted = brute(rows)
    found, error = {}, set()
    for r in got:
        assert r.n == n
        error.add(r.identity_error)
        found.setdefault((r.vec_id, r.component), []).append((r.deviation, abs(r.whitened), r.explained))
    assert len(error) == 1 and error.pop() < 1e-9
    assert found.keys() == wanted.keys()
    for key, one in wanted.items():
        for a, b in zip(sorted(one), sorted(found[key]), strict=True):
            assert a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-7)


def odd_vectors():
    rng = np.random.default_rng(2)
    shape = np.array([3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.2])
    rows = [(k, [float(c) for c in rng.standard_normal(10) * shape], 0) for k in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (-9, rows[6][1], 1)]
    rows += [(100, None, 0), (101, [], 0), (102, [1.0] * 9 + [None], 0), (103, [float("nan")] * 10, 0), (104, [float("inf")] + [0.0] * 9, 0)]
    return rows + [(105, [1.0, 2.0], 0), (106, [0.0] * 10, 0)]


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_odd_rows(spark, parts):
    df = spark.createDataFrame(odd_vectors(), KINDS).repartition(parts)
    df = df.select("*", *(F.lit(1).alias(c) for c in ("x", "v", "n", "part", "length", "component", "sums")))
    compare(op.whitening(df).collect(), odd_vectors())


def test_no_variance_few_rows_and_none(spark):
    assert op.whitening(spark.createDataFrame([], KINDS)).collect() == []
    rows = op.whitening(spark.createDataFrame([(1, [0.5] * 3, 0)] * 4, KINDS)).collect()
    assert len(rows) == 12 and {tuple(r)[2:] for r in rows} == {(4, 0, 0.0, 0.0, 0.0)}
    rows = [(k, [float(k), 2.0 * k, 1.0], 0) for k in range(5)]
    compare(op.whitening(spark.createDataFrame(rows, KINDS)).collect(), rows)
    huge = [(k, [1e30 * k, 1.0 * k], 0) for k in range(3)]
    assert {r.deviation for r in op.whitening(spark.createDataFrame(huge, KINDS)).collect()} == {None}


def test_whole_table(spark):
    table = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in table.collect()]
    compare(op.query(spark, SMALL.replace("0.001", "0.01")).collect(), rows)
