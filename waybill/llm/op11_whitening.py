"""Whitening of embeddings: an eigendecomposition kept up row by row.

Each task holds count, mean and spectrum of the rows it has read.  A row adds a centred
rank-one term: the eigenvalues of a diagonal plus a rank-one matrix are the roots of a
secular equation, the eigenvectors follow in closed form from the roots (with the vector
recomputed from them, which keeps the eigenvectors orthogonal).  Directions that the row
does not touch, and all but one of a set of equal eigenvalues, are deflated first.
Spectra of tasks combine in the same way, one rank-one term for each direction of the
smaller side and one for the distance of the means, in a tree of ``FAN`` spectra a task.
At the end the covariance over all rows is projected on the eigenvectors found, summed by
task, and its small eigenproblem (Rayleigh-Ritz on the whole space) makes them exact to
double precision, whatever the tree did.

A row costs one product of a square matrix of the dimension; a task holds a few of them.
Sums of the entries are exact whole numbers, so mean and deviation depend on no order.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are
left out, and so are vectors that do not have the most frequent length (of equally
frequent lengths the largest stays).  Repeated rows and rows without id count.  Entries
beyond ``BOUND`` after scaling are set to it.  A deviation beyond a long is null.  A
component without variance has whitened 0 and explained 0 and is not in the identity
error, which is 0 when there is none.  Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import added, stage, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 8
BOUND = float(1 << 52)
_EPS = np.finfo(float).eps
_LONG = 2**63


class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the centred sum of squares."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        """One more row."""
        apart = x - self.mean
        self.n += 1
        self.mean = self.mean + apart / self.n
        if self.n > 1:
            self.rank_one(apart, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        """All rows of another spectrum."""
        if not other.n:
            return
        apart, total = other.mean - self.mean, self.n + other.n
        weight = self.n * other.n / total
        self.mean = self.mean + apart * (other.n / total)
        self.n = total
        if weight:
            self.rank_one(apart, weight)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.rank_one(vector, float(value))

    def rank_one(self, x: np.ndarray, weight: float) -> None:
        """The spectrum after ``weight`` x x' is added."""
        z = self.vectors.T @ x
        length = float(np.sqrt(z @ z))
        if not length:
            return
        z /= length
        rho = weight * length * length
        values, tolerance = self.values, 8 * _EPS * max(float(self.values[-1]), rho)
        # Deflation: of nearly equal eigenvalues one direction takes all of the row.
        for start, end in _runs(np.diff(values) <= tolerance):
            self._gather(z, start, end)
        live = np.flatnonzero(rho * np.abs(z) > tolerance)
        if not len(live):
            return
        roots, turn = secular(values[live], z[live], rho)
        values = values.copy()
        values[live] = roots
        self.vectors[:, live] = self.vectors[:, live] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], self.vectors[:, order]

    def _gather(self, z: np.ndarray, start: int, end: int) -> None:
        """Reflect the directions start..end so that the row lies in the last one only."""
        part = z[start:end].copy()
        size = float(np.sqrt(part @ part))
        if not size or not part[:-1].any():
            return
        mirror = part.copy()
        mirror[-1] += np.copysign(size, part[-1])
        mirror /= np.sqrt(mirror @ mirror)
        own = self.vectors[:, start:end]
        own -= 2 * np.outer(own @ mirror, mirror)
        z[start:end] = 0
        z[end - 1] = -np.copysign(size, part[-1])

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, dim: int) -> Spectrum:
        flat = np.frombuffer(raw, np.float64)
        own = cls(dim)
        own.n, own.mean, own.values = int(flat[0]), flat[1 : dim + 1].copy(), flat[dim + 1 : 2 * dim + 1].copy()
        own.vectors = flat[2 * dim + 1 :].reshape(dim, dim).copy()
        return own


def _runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of more than one place whose neighbours are the same."""
    if not same.any():
        return []
    edges = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + 1).tolist(), strict=True))


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', d rising, no z zero, rho > 0.

    Root k lies between d[k] and d[k + 1], the last one below d[-1] + rho z'z.  It is
    sought as its distance from the nearer pole: a step takes the rational function with
    the two neighbouring poles through value and slope, halving guards it.
    """
    k = len(d)
    if k == 1:
        return d + rho * z * z, np.ones((1, 1))
    zz = z * z
    upper = np.append(d[1:], d[-1] + rho * zz.sum())
    gap = upper - d
    base = d[None, :] - d[:, None]  # base[r, i]: pole i seen from pole r
    middle = 1 + rho * (zz / (base - gap[:, None] / 2)).sum(axis=1)
    right = middle < 0  # the function rises, so the root lies in the right half
    right[-1] = False
    origin = np.arange(k) + right
    poles = d[None, :] - d[origin][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    last_half = middle[-1] < 0
    low[-1], high[-1] = (gap[-1] / 2, gap[-1]) if last_half else (0.0, gap[-1] / 2)
    at = (low + high) / 2
    left_pole = np.where(right, -gap, 0.0)
    # Without a pole to the right the step comes from the left one alone.
    right_pole = np.append(np.where(right, 0.0, gap)[:-1], np.inf)
    split = np.tri(k)
    open_ = np.arange(k)
    for _ in range(100):
        x, pole, left = at[open_], poles[open_], split[open_]
        apart = pole - x[:, None]
        term = rho * zz / apart
        slope = term / apart
        f = 1 + term.sum(axis=1)
        below, below_slope = np.einsum("ij,ij->i", term, left), np.einsum("ij,ij->i", slope, left)
        # No value can be told from zero below the rounding of its sum; terms on the left are negative.
        wrong = np.abs(f) > 4 * _EPS * (f - 2 * below)
        low[open_], high[open_] = np.where(f <= 0, x, low[open_]), np.where(f > 0, x, high[open_])
        total, total_slope = f - 1, slope.sum(axis=1)
        to_left, to_right = left_pole[open_] - x, right_pole[open_] - x
        last = np.isinf(to_right)
        to_right[last] = 0
        # Each side as s + r / (pole - x) with its own value and slope, r = a or b:
        # c + a / (to_left - step) + b / (to_right - step) = 0.
        a = below_slope * to_left * to_left
        b = (total_slope - below_slope) * to_right * to_right
        c = 1 + total - below_slope * to_left - (total_slope - below_slope) * to_right
        p = -(c * (to_left + to_right) + a + b)
        q = c * to_left * to_right + a * to_right + b * to_left
        with np.errstate(all="ignore"):
            half = -(p + np.copysign(np.sqrt(np.maximum(p * p - 4 * c * q, 0)), p)) / 2
            one, two = np.where(last, to_left + a / c, half / c), q / half
        lowest, highest = low[open_], high[open_]
        new = np.where((x + two > lowest) & (x + two < highest), x + two, (lowest + highest) / 2)
        new = np.where((x + one > lowest) & (x + one < highest), x + one, new)
        wrong &= highest - lowest > 2 * _EPS * np.maximum(np.abs(lowest), np.abs(highest))
        open_ = open_[wrong]
        if not len(open_):
            break
        at[open_] = new[wrong]
    away = poles - at[:, None]  # d[i] - root k, exact where they are near
    # The row for which the roots found are exact: each root is paired with a pole.
    before = np.arange(k)[:, None] < np.arange(k)[None, :]
    pairs = np.where(before, away, np.vstack([np.ones((1, k)), away[:-1]]))
    np.fill_diagonal(pairs, 1)
    np.fill_diagonal(base, 1)
    exact = np.copysign(np.sqrt(np.abs((pairs / base).prod(axis=0) * away[-1] / rho)), z)
    vectors = exact[None, :] / away
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return d[origin] + at, vectors.T


def plain(rows: DataFrame) -> DataFrame:
    """vec_id and the whole-number vector x of every row that takes part."""
    entries = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(
        "v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(BOUND)), F.lit(-BOUND))).cast("long") + SHIFT
    )
    fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("v")).filter(F.size("v") > 0).filter(sound)
    fit = stage(fit.select("vec_id", whole.alias("x")), "whole-vectors")
    lengths = fit.groupBy(F.size("x").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return fit.filter(F.size("x") == (most.length if most else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(len(batch), -1)


def _sums(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    small = len(x) == 0 or float(np.abs(x).max()) * len(x) < _LONG / 2
    return [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]


def spectrum(fit: DataFrame, fan: int = FAN) -> tuple[Spectrum, list[int]] | None:
    """The spectrum of all rows of ``fit`` less SHIFT, and their exact sums; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, sums = None, []
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                own = own or Spectrum(x.shape[1])
                sums = [a + b for a, b in zip(sums or [0] * x.shape[1], _sums(x), strict=True)]
                for row in (x - SHIFT).astype(np.float64):
                    own.add(row)
        if own:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "sums": [json.dumps(sums)], "spectrum": [own.pack()]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        sums = np.array([json.loads(s) for s in parts["sums"]], object).sum(axis=0).tolist()
        total, *rest = (Spectrum.unpack(raw, len(sums)) for raw in parts["spectrum"])
        for other in rest:
            total.merge(other)
        return pd.DataFrame({"part": [parts["part"].iloc[0] // fan], "sums": [json.dumps(sums)], "spectrum": [total.pack()]})

    kinds = "part long, sums string, spectrum binary"
    parts, count = fit.select("x").mapInArrow(run, kinds), fit.rdd.getNumPartitions()
    while count > 1:
        parts, count = parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merged, kinds), -(-count // fan)
    row = parts.first()
    if row is None:
        return None
    sums = json.loads(row.sums)
    return Spectrum.unpack(row.spectrum, len(sums)), sums


class Whitening:
    """The components of the fit list: unit vectors, eigenvalues, and what they explain."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums = n, sums
        self.mean = np.array([float(Fraction(s - SHIFT * n, n)) for s in sums])
        live = values > 64 * _EPS * len(values) * max(trace, 0.0)
        self.explained = np.where(live, values / (trace or 1.0), 0.0)
        self.live = live
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        self.turn = vectors * np.where(live, np.sign(largest) / np.sqrt(np.where(live, values, 1)), 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - SHIFT).astype(np.float64) - self.mean) @ self.turn

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact."""
        sums = np.array(self.sums, object)
        most = float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if most < _LONG / 4:
            apart = x * np.int64(self.n) - sums.astype(np.int64)
            if len(self.sums) * float(np.abs(apart).max(initial=0)) ** 2 < _LONG / 4:
                return pa.array((apart * apart).sum(axis=1))
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return pa.array([int(v) if v < _LONG else None for v in exact], pa.int64())


def refined(fit: DataFrame, found: Spectrum, sums: list[int], components: int = COMPONENTS) -> Whitening:
    """Rayleigh-Ritz over all rows, on the whole space that the spectrum spans."""
    n, dim = found.n, len(sums)
    mean = np.array([float(Fraction(s - SHIFT * n, n)) for s in sums])
    basis = np.linalg.qr(found.vectors)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                y = ((_matrix(batch) - SHIFT).astype(np.float64) - mean) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    projected = added(fit.select("x").mapInArrow(run, "part binary"), dim * dim).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    top = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, basis @ turn[:, top], values[top], float(np.trace(projected)))


def identity_error(fit: DataFrame, white: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(white.live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if len(batch):
                w = white.whitened(_matrix(batch))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    total = added(fit.select("x").mapInArrow(run, "part binary"), (k + 1) * k).reshape(k + 1, k) / white.n
    apart = total[:k] - np.outer(total[k], total[k]) - np.eye(k)
    return float(np.abs(apart[np.ix_(white.live, white.live)]).max(initial=0.0))


_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector of ``rows`` (vec_id, embedding) and component."""
    fit = plain(rows)
    if (found := spectrum(fit)) is None:
        return fit.sparkSession.createDataFrame([], _COLUMNS)
    white = refined(fit, *found, components)
    error = identity_error(fit, white)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, k = _matrix(batch), len(white.live)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            columns = [
                batch.column("vec_id").take(at), pa.array(numbers), pa.array(np.full(len(numbers), white.n, np.int64)),
                white.deviations(x).take(at), pa.array(white.whitened(x).ravel()), pa.array(np.tile(white.explained, len(x))),
                pa.array(np.full(len(numbers), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return fit.mapInArrow(run, _COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
