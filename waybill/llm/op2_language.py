"""Language of documents: a bidirectional gated recurrent network over bytes.

The network reads windows of bytes forwards and backwards, gives language
probabilities at every position, and a document's probabilities are the mean over all
its positions.  Gates use piecewise linear activations, which cost little per byte.
Training is backpropagation through time in numpy on the driver.

The training sample is bounded: at most ``SAMPLE`` documents of each language outside
the held-out fold, drawn by a hash, and of them ``STEPS`` batches of windows at random
places, languages in equal parts.  All texts are labelled whole, in windows of
``WINDOW`` bytes that each start from a zero state.

Null texts and texts without a letter are ``und`` with score 0.  Without any training
row every text is ``und``.  One row comes back per document row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import documents, remainder, table
from waybill.llm.recurrent import Adam, Gated
from waybill.llm.sampling import sample_of_each
from waybill.llm.words import buffers, slices

FOLDS = 5
SAMPLE = 750
STEPS = 500
BATCH = 256
TRAIN_WINDOW = 48
WINDOW = 128
UNITS = 8
LANES = 2048
RATE = 0.01
SEED = 20261202
UNDETERMINED = "und"
_PAD = 256


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; numerals such as ½ and ② are none."""
    return bool(text) and any(map(str.isalpha, text))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Network:
    """Both directions and the output layer."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.there, self.back = Gated(units, _PAD + 1, rng), Gated(units, _PAD + 1, rng)
        self.hold_padding()
        self.out = (rng.standard_normal((2, len(languages), units)) * 0.3).astype(np.float32)
        self.shift = np.zeros((len(languages), 1), np.float32)

    def hold_padding(self) -> None:
        """A padding byte leaves the state as it is: its update gate is full."""
        for layer in (self.there, self.back):
            layer.table[:, _PAD] = 0
            layer.table[layer.units : 2 * layer.units, _PAD] = 1e3

    def probabilities(self, bytes_: np.ndarray, kept: tuple[list, list] | None = None) -> tuple:
        """(time, language, lane) probabilities, and the states of both directions."""
        ahead = self.there.run(bytes_, keep=kept and kept[0])[0]
        behind = self.back.run(bytes_[::-1], keep=kept and kept[1])[0][::-1]
        logits = np.matmul(self.out[0], ahead)
        logits += np.matmul(self.out[1], behind)
        logits += self.shift
        return _softmax(logits), ahead, behind

    def train_step(self, bytes_: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients; every position is to name its window's language."""
        kept: tuple[list, list] = ([], [])
        p, ahead, behind = self.probabilities(bytes_, kept)
        lanes = np.arange(len(wanted))
        real = (bytes_ != _PAD)[:, None, :]
        loss = -float(np.log(np.maximum(p[:, wanted, lanes], 1e-9)).mean())
        p[:, wanted, lanes] -= 1
        p *= real / max(1, real.sum())
        out = np.stack([np.einsum("tlb,tub->lu", p, h, optimize=True) for h in (ahead, behind)])
        shift = p.sum(axis=(0, 2))[:, None]
        first = self.there.gradients(kept[0], np.matmul(self.out[0].T, p))
        second = self.back.gradients(kept[1], np.matmul(self.out[1].T, p)[::-1])
        return loss, [*first, *second, out, shift]

    def parameters(self) -> list[np.ndarray]:
        both = [*self.there.parameters(), *self.back.parameters()]
        return [*both, self.out, self.shift]


def train(texts: list[bytes], languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network | None:
    """A network fitted on windows of the texts; None without any byte."""
    pairs = [(t, l) for t, l in zip(texts, languages, strict=True) if t]
    if not pairs:
        return None
    network = Network(sorted({l for _, l in pairs}))
    rng = np.random.default_rng(seed)
    by_language = [[np.frombuffer(t, np.uint8) for t, l in pairs if l == name] for name in network.languages]
    sums = [np.cumsum([len(t) for t in own]) for own in by_language]
    adam = Adam(network.parameters(), RATE)
    for step in range(steps):
        wanted = rng.integers(0, len(by_language), BATCH)
        window = np.full((TRAIN_WINDOW, BATCH), _PAD, np.int64)
        for lane, k in enumerate(wanted):
            at = rng.integers(0, sums[k][-1])  # a byte of all the language's bytes
            text = by_language[k][int(np.searchsorted(sums[k], at, "right"))]
            start = int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW + 1)))
            part = text[start : start + TRAIN_WINDOW]
            window[: len(part), lane] = part
        _, gradients = network.train_step(window, wanted)
        adam.step(gradients, 1.0 if step < steps * 0.6 else 0.2)
        network.hold_padding()
    return network


def _windows(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of all texts, and the text of each."""
    sizes = np.diff(cuts)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = cuts[:-1][owner] + within * WINDOW
    return starts, np.minimum(WINDOW, cuts[1:][owner] - starts), owner


def pooled(network: Network, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each text; zeros for an empty one."""
    starts, lengths, owner = _windows(data, cuts)
    total = np.zeros((len(cuts) - 1, len(network.languages)))
    order = np.argsort(-lengths, kind="stable")  # full windows together need no padding
    for first in range(0, len(order), LANES):
        some = order[first : first + LANES]
        longest = int(lengths[some[0]])
        steps = np.arange(longest)[:, None]
        place = starts[some][None, :] + steps
        inside = steps < lengths[some][None, :]
        if inside.all():
            p, _, _ = network.probabilities(data[place].astype(np.intp))
            sums = p.sum(axis=0)
        else:
            block = np.where(inside, data[np.minimum(place, len(data) - 1)].astype(np.intp), _PAD)
            p, _, _ = network.probabilities(block)
            sums = np.where(inside[:, None, :], p, 0).sum(axis=0)
        for k in range(len(network.languages)):
            total[:, k] += np.bincount(owner[some], sums[k], len(total))
    return total / np.maximum(np.diff(cuts), 1)[:, None]


@dataclass
class Reader:
    """Predicts the languages of texts."""

    network: Network | None

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        strings = texts.to_pylist()
        known = np.array([has_letter(t) for t in strings], bool)
        if self.network is None or not known.any():
            return [UNDETERMINED] * len(strings), np.zeros(len(strings))
        p = pooled(self.network, *buffers(texts))
        best = p.argmax(axis=1)
        names = [self.network.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.round(np.clip(p.max(axis=1), 0, 1), 6), 0.0)


def fit(docs: DataFrame, folds: int = FOLDS, most: int = SAMPLE) -> Network | None:
    """A network trained on at most ``most`` rows of each language outside the held-out fold."""
    rows = documents(docs, "doc_id", "text", "lang").filter(remainder(folds) != 0).filter("lang IS NOT NULL")
    got = sample_of_each(rows, "lang", most, "text", "lang", text=F.col("text"))
    got = [(r.text.encode("utf-8", "replace"), r.lang) for r in got if has_letter(r.text)]
    return train([t for t, _ in got], [l for _, l in got])


def languages(docs: DataFrame, network: Network | None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in slices(batches, size=2 << 20):
            names, scores = reader(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    found = documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(folds) == 0).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit(docs))
