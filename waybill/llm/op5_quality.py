"""Document quality: random Fourier features, ridge scores, isotonic calibration.

Each text gives some statistics of its bytes, words and lines.  Scaled by the training
rows' mean and deviation, they are mapped to ``FEATURES`` cosines whose products
approximate a Gaussian kernel.  Every task adds up its part of the normal equations of
the labelled training rows, the parts are added in a tree, and the driver solves one
small system.  Scores are calibrated by pooling adjacent violators over score bins.

Learning uses every labelled row outside the held-out fold (no sample); several labels
of one id are averaged, null labels and ids are left out.  Null and empty texts get the
statistics of an empty text and so a score.  Without any label all scores are 0.5.  One
row comes back per document row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import added, documents, remainder, stage, table
from waybill.llm.words import SPACED, buffers, slices, word_hashes, word_spans

FOLDS = 5
THRESHOLD = 0.3
FEATURES = 256
RIDGE = 1e-4
# Width of the kernel, in standard deviations per root of the number of statistics.
SPREAD = 1.0
CLIP = 4.0
BINS = 1000
SEED = 20261205

_LINES = np.ones(256, bool)
_LINES[10] = False
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 13), "newline": (10,),
    "stop": (44, 46, 59, 58, 63), "exclaim": (33,), "mark": (35, 36, 37, 38, 42, 64, 94, 126), "bar": (124, 92, 47, 60, 62, 91, 93, 123, 125, 95, 61, 43),
    "quote": (34, 39, 40, 41, 45, 96), "control": (*range(9), 11, 12, *range(14, 32), 127), "beyond": range(128, 256),
}
NAMES = [
    "bytes", "words", "lines", "word_length", "word_spread", "line_words", "distinct_words", "top_word", "distinct_lines",
    "entropy", "doubled", *_CLASSES,
]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text, in the order of ``NAMES``."""
    data, cuts = buffers(texts)
    starts, ends, first = word_spans(data, cuts, SPACED)
    words, lengths = word_hashes(data, starts, ends), (ends - starts).astype(float)
    line_starts, line_ends, line_first = word_spans(data, cuts, _LINES)
    lines = word_hashes(data, line_starts, line_ends)
    member = np.zeros((256, len(_CLASSES)))
    for k, codes in enumerate(_CLASSES.values()):
        member[list(codes), k] = 1
    out = np.zeros((len(texts), len(NAMES)))
    for k in range(len(texts)):
        own = data[cuts[k] : cuts[k + 1]]
        n, w, m = len(own), first[k + 1] - first[k], line_first[k + 1] - line_first[k]
        if not n:
            continue
        counts = np.bincount(own, minlength=256)
        some = counts[counts > 0] / n
        row = [np.log1p(n), np.log1p(w), np.log1p(m)]
        if w:
            _, times = np.unique(words[first[k] : first[k + 1]], return_counts=True)
            length = lengths[first[k] : first[k + 1]]
            same = lines[line_first[k] : line_first[k + 1]]
            row += [
                length.mean(), length.std(), np.log1p(w / m), len(times) / w ** 0.8, times.max() / w,
                len(np.unique(same)) / m, -(some * np.log(some)).sum(),
            ]
            row.append(float((words[first[k] + 1 : first[k + 1]] == words[first[k] : first[k + 1] - 1]).mean()) if w > 1 else 0.0)
        else:
            row += [0.0] * 8
        out[k, : len(row)] = row
        out[k, len(row) :] = np.sqrt(counts @ member / n)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(values[:, k]) for k in range(len(NAMES)))], ["doc_id", *NAMES]
            )

    kinds = ", ".join(f"{n} double" for n in NAMES)
    return documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in NAMES], 1)


@dataclass
class Kernel:
    """The cosine map and, once fitted, weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, values: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((len(NAMES), FEATURES)) / (SPREAD * np.sqrt(len(NAMES)))
        shifts = rng.random(FEATURES) * 2 * np.pi
        x = np.clip((values - self.mean) / self.scale, -CLIP, CLIP)
        out = np.empty((len(x), FEATURES + 1))
        out[:, :-1] = np.cos(x @ directions + shifts) * np.sqrt(2 / FEATURES)
        out[:, -1] = 1
        return out

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Calibrated scores; a small slope keeps the order inside level steps."""
        if self.weights is None:
            return np.full(len(values), 0.5)
        raw = self.raw(values)
        level = np.interp(raw, self.knots, self.levels)
        return np.round(np.clip(0.999 * level + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1), 9)


def _equations(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of the labelled rows, added up by task."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z, y = kernel.features(_matrix(batch)), batch.column("y").to_numpy()
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = added(train.mapInArrow(run, "part binary"), size * (size + 1)).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def pooled(scores: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and levels of a non-decreasing fit."""
    blocks: list[list[float]] = []
    for s, y, n in zip(scores, sums, counts, strict=True):
        blocks.append([s * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(features: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Kernel:
    """A kernel fitted on the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).dropna()
    known = known.filter(remainder(folds) != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = stage(features.join(known, "doc_id").select("y", *NAMES), "labelled")
    count = F.count("y").alias("count")
    moments = train.agg(count, *(f(n) for n in NAMES for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Kernel(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    kernel = Kernel(np.array(moments[1::2]), np.maximum(np.array(moments[2::2]), 1e-6))
    gram, right = _equations(train, kernel)
    kernel.weights = np.linalg.solve(gram + (RIDGE * moments[0] + 1e-6) * np.eye(len(gram)), right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.rint(np.clip(kernel.raw(_matrix(batch)), -1, 2) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], ["bin", "y"])

    binned = train.mapInArrow(run, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    rows = sorted(binned.collect())  # at most 3 * BINS + 1 rows
    kernel.knots, kernel.levels = pooled(
        np.array([r.bin / BINS for r in rows]), np.array([r.y for r in rows]), np.array([float(r.n) for r in rows])
    )
    return kernel


def scored(features: DataFrame, kernel: Kernel, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = kernel.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (remainder(folds) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    features = stage(measured(docs), "statistics")
    return scored(features, fit(features, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
