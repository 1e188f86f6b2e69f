"""Log-likelihood of documents under a gated recurrent language model.

Word counts come from all training texts.  Their most frequent words, at most ``HEAD``,
are sent to the tasks; the rest, the tail, is looked up by a join.  Output is factored in classes:
P(word) = P(class | state) * P(word | class).  The ``OWN`` most frequent words stand in
classes of ``CLASS`` words with a softmax of their own on the state; the other head
words stand in classes by theme and frequency, the tail in one class, each with its
corpus counts as word probabilities.  The end of a text is a class of one.

The recurrent part is trained by backpropagation through time, truncated at windows of
``STEPS_BACK`` words with the state carried on, on all training documents: in each of
``ROUNDS`` rounds every task trains a copy of the model on its documents of that round,
and the copies are averaged by their words.  Over all rounds each document is read
``PASSES`` times, whatever the size of the corpus.
Themes are groups of all training documents by their frequent words; only where the
groups' centres start is drawn from at most ``SAMPLE`` documents.  Scoring carries the state through every document from its first word to
its end, many documents side by side.

Counts, base scores and the word probabilities cover all training texts.  Words are
64-bit hashes.  Null and empty texts consist of the end token alone.  Without training
texts all counts are 0 and the score equals the base score.  One row per document row.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import documents, remainder, stage, table
from waybill.llm.recurrent import Adam, Gated
from waybill.llm.sampling import sample
from waybill.llm.words import hashed, slices

FOLDS = 10
HEAD = 1 << 17
OWN = 1024
CLASS = 32
THEMES = 8
BANDS = 2
UNITS = 16
SAMPLE = 4000
# Rounds of training, and how often each document is read in all of them together.
ROUNDS = 4
PASSES = 1
TRAIN_LANES = 128
STEPS_BACK = 24
RATE = 0.01
LANES = 512
STEPS = 32
COUNT_BYTES = 16 << 20
SCORE_BYTES = 12 << 20
SEED = 20261208
# Sums of fractions over tasks are whole numbers of this part, so that their order is free.
UNIT = 1 << 20


def summed(docs: DataFrame, measure: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of the long arrays that ``measure`` makes of the texts of each task.

    Arrays are added up in tasks, so that one comes to the driver; None if there are none.
    """

    def row(found: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.astype(np.int64).tobytes()], pa.binary())], ["sums"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from row(measure(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                part = np.frombuffer(data.as_buffer(), np.int64)
                total = part.copy() if total is None else total + part
        yield from row(total)

    texts = docs.select("text")
    tasks = texts.rdd.getNumPartitions()
    found = texts.mapInArrow(one, "sums binary")
    for count in (max(1, isqrt(tasks)), 1):
        found = found.repartition(count).mapInArrow(add, "sums binary")
    rows = found.collect()
    return np.frombuffer(rows[0].sums, np.int64) if rows else None


# -- corpus counts ---------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of (text); counted by slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=COUNT_BYTES):
            words, n = np.unique(hashed(batch.column("text"))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Corpus:
    """Totals of the training texts and their most frequent words (sorted by hash)."""

    tokens: int
    texts: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray

    @property
    def divisor(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)


def corpus_of(counts: DataFrame, texts: int) -> Corpus:
    total = counts.agg(F.sum("n").alias("n"), F.count("word").alias("v")).first()
    # The head ends where a class of counts would lead beyond HEAD words.  There are at
    # most 64 classes to a doubling; a top-k would send its k rows from every task.
    band = F.floor(F.log2("n") * 64)
    bands = counts.groupBy(band.alias("band")).agg(F.count("word").alias("words")).collect()
    words, least = 0, None
    for row in sorted(bands, key=lambda r: -r.band):
        words += row.words
        if words > HEAD:
            break
        least = row.band
    head = counts.filter(band >= least if least is not None else F.lit(False)).toPandas().sort_values("word")
    tokens, distinct = (total.n or 0) + texts, total.v + (texts > 0)
    return Corpus(tokens, texts, distinct, head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The word hashes of each text, by slice."""
    for batch in slices(batches, size=SCORE_BYTES):
        words, firsts = hashed(batch.column("text"))
        yield [words[a:b].view(np.int64) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


# -- vocabulary ------------------------------------------------------------------------

@dataclass
class Vocabulary:
    """For each head word its input symbol, class, place in the class and fixed part.

    Entry -1 of each array is the tail, entry -2 the end of a text.
    """

    words: np.ndarray
    symbol: np.ndarray
    group: np.ndarray
    place: np.ndarray
    inside: np.ndarray  # log probability within a class of fixed probabilities
    own_groups: int
    groups: int
    symbols: int
    chains: tuple[np.ndarray, np.ndarray] | None = None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each word; -1 for the tail."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        if self.chains is None:
            self.chains = self._chained()
        first, following = self.chains
        at = first.take(self._slots(hashes))
        # An empty slot's -1 meets the last word, which stands in another slot.
        open_ = np.flatnonzero(self.words.take(at) != hashes)
        while len(open_):
            at[open_] = following.take(at[open_])
            open_ = open_[at[open_] >= 0]
            open_ = open_[self.words.take(at[open_]) != hashes[open_]]
        return at

    def entries(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Entries of the words of each text."""
        cuts = np.cumsum([0, *map(len, texts)]).tolist()
        flat = self.numbers(np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each word, about four to a head word."""
        bits = len(self.words).bit_length() + 2
        return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def _chained(self) -> tuple[np.ndarray, np.ndarray]:
        """The first entry of each slot, and which entry follows each in its slot; -1 for none."""
        n = len(self.words)
        slots = self._slots(self.words)
        order = np.argsort(slots, kind="stable")
        ordered = slots[order]
        first, following = np.full(1 << (n.bit_length() + 2), -1), np.full(n + 1, -1)
        starts = np.append(True, ordered[1:] != ordered[:-1])
        first[ordered[starts]] = order[starts]
        following[order[:-1][~starts[1:]]] = order[1:][~starts[1:]]
        return first, following

    def __getstate__(self) -> dict:
        """Tasks make the chains anew, which is cheaper than sending them."""
        return self.__dict__ | {"chains": None}


def frequent(texts: list[np.ndarray], top: int) -> np.ndarray:
    """Direction of each text by its frequent words (given as ranks)."""
    x = np.zeros((len(texts), top), np.float32)
    for k, t in enumerate(texts):
        own = t[(t >= 0) & (t < top)]
        x[k] = np.sqrt(np.bincount(own, minlength=top))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    return x


def first_centres(texts: list[np.ndarray], top: int) -> np.ndarray:
    """Spherical k-means of some texts."""
    rng = np.random.default_rng(SEED)
    x = frequent(texts, top)
    centres = x[rng.permutation(len(x))[:THEMES]]
    for _ in range(12):
        best = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (best == c).any():
                centres[c] = x[best == c].sum(axis=0)
                centres[c] /= max(float(np.sqrt((centres[c] ** 2).sum())), 1e-9)
    return centres


def centre_sums(texts: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """Sum of the texts nearest to each centre, in parts of ``UNIT``."""
    out = np.zeros(centres.shape, np.int64)
    for start in range(0, len(texts), LANES):
        x = frequent(texts[start : start + LANES], centres.shape[1])
        best = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            out[c] += np.rint(x[best == c] * UNIT).astype(np.int64).sum(axis=0)
    return out.ravel()


def votes(texts: list[np.ndarray], centres: np.ndarray, entries: int) -> np.ndarray:
    """Number of texts of each theme that hold a word, by word; then that of all texts."""
    out = np.zeros((THEMES, entries + 1), np.int64)
    for start in range(0, len(texts), LANES):
        some = texts[start : start + LANES]
        best = (frequent(some, centres.shape[1]) @ centres.T).argmax(axis=1)
        for t, c in zip(some, best.tolist(), strict=True):
            own = out[c]
            own[t[t >= 0]] += 1  # a word that comes several times is raised once
            own[-1] += 1
    return out.T.ravel()


def themes_of(total: Callable[[Callable], np.ndarray], start: np.ndarray, entries: int) -> np.ndarray:
    """Theme of every head word: where the texts that hold it belong.

    ``total`` sums a function of lists of texts over all of them.  Words that occur in
    no text get a theme of their own.
    """
    centres = total(lambda texts: centre_sums(texts, start)).reshape(start.shape).astype(np.float32)
    length = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    centres = np.where(length > 0, centres / np.maximum(length, 1e-9), start)
    found = total(lambda texts: votes(texts, centres, entries)).reshape(entries + 1, THEMES)
    shares = np.full((entries, THEMES + 1), 1e-9)
    shares[:, :THEMES] = found[:-1] / (found[-1] + 1.0)
    return shares.argmax(axis=1)


def make_vocabulary(corpus: Corpus, texts: list[np.ndarray], docs: DataFrame | None = None) -> Vocabulary:
    """Classes of all head words, by the themes of ``docs``; ``texts`` are word hashes.

    The themes start from ``texts`` and are theirs where there are no ``docs``.
    """
    n = len(corpus.words)
    order = np.lexsort((corpus.words, -corpus.counts))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    own = min(OWN, n)
    empty = Vocabulary(corpus.words, *(np.zeros(0, np.int64),) * 4, 0, 0, 0)

    def ranks(words: list[np.ndarray]) -> list[np.ndarray]:
        return [np.where(e >= 0, rank[e] if n else -1, -1) for e in empty.entries(words)]

    def total(measure: Callable) -> np.ndarray:
        if docs is None:
            return measure(ranks(texts))

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            out = None
            for words in texts_of(batches):
                part = measure(ranks(words))
                out = part if out is None else out + part
            return out

        return summed(docs, run)

    theme = themes_of(total, first_centres(ranks(texts), own), n)[rank] if n and texts else np.zeros(n, np.int64)
    symbol, group, place = (np.zeros(n + 2, np.int64) for _ in range(3))
    inside = np.zeros(n + 2)
    first = order[:own]
    first = first[np.lexsort((rank[first], theme[first]))]
    symbol[first] = np.arange(own)
    group[first], place[first] = np.arange(own) // CLASS, np.arange(own) % CLASS
    own_groups = -(-own // CLASS)
    # The other head words: by theme, and by halves of the words' mass.
    rest = order[own:]
    mass = np.cumsum(corpus.counts[rest])
    band = np.minimum((mass - corpus.counts[rest]) * BANDS // max(1, mass[-1] if len(mass) else 1), BANDS - 1)
    names, number = np.unique(theme[rest] * BANDS + band, return_inverse=True)
    group[rest] = own_groups + number
    symbol[rest] = own + number
    sums = np.bincount(number, corpus.counts[rest], len(names))
    inside[rest] = np.log10(corpus.counts[rest] / sums[number]) if len(rest) else 0
    tail, end = own_groups + len(names), own_groups + len(names) + 1
    group[-1], symbol[-1] = tail, own + len(names)
    group[-2], symbol[-2] = end, own + len(names) + 1
    return Vocabulary(corpus.words, symbol, group, place, inside, own_groups, end + 1, own + len(names) + 2)


# -- the model -------------------------------------------------------------------------

class Model:
    """Recurrent state, class softmax and a softmax inside each class of own words."""

    def __init__(self, vocabulary: Vocabulary):
        rng = np.random.default_rng(SEED)
        v = vocabulary
        self.vocabulary = v
        self.read = 0  # entries it was trained on
        self.state = Gated(UNITS, v.symbols, rng)
        self.out = (rng.standard_normal((v.groups, UNITS)) * 0.1).astype(np.float32)
        self.shift = np.zeros((v.groups, 1), np.float32)
        self.word_out = (rng.standard_normal((v.own_groups, CLASS, UNITS)) * 0.1).astype(np.float32)
        self.word_shift = np.zeros((v.own_groups, CLASS, 1), np.float32)
        last = len(v.words) and min(OWN, len(v.words)) % CLASS
        if last:  # places without a word
            self.word_shift[-1, last:] = -1e4

    def start(self, counts: np.ndarray, tail: float, texts: float) -> None:
        """Begin at the corpus frequencies."""
        v = self.vocabulary
        mass = np.bincount(v.group, np.concatenate([counts, [texts, tail]]), v.groups) + 0.5
        self.shift[:, 0] = np.log(mass / mass.sum())
        own = v.group[:-2] < v.own_groups
        self.word_shift[v.group[:-2][own], v.place[:-2][own], 0] = np.log(counts[own] + 0.5)

    def parameters(self) -> list[np.ndarray]:
        return [*self.state.parameters(), self.out, self.shift, self.word_out, self.word_shift]

    def log10(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 P(class) P(word | class) of each column; the tail's inner part is left out."""
        v = self.vocabulary
        group = v.group[targets]
        logits = self._logits(self.out, self.shift, states, self._far(self.out, self.shift))
        picked = logits[group, np.arange(len(targets))]
        np.exp(logits, out=logits)
        out = picked - np.log(logits.sum(axis=0))
        order, cuts, place, columns = self._by_group(states, targets, group)
        picked, sums = np.empty(len(order), logits.dtype), np.empty(len(order), logits.dtype)
        far, places = self._far(self.word_out, self.word_shift).tolist(), np.arange(len(order))
        for c in range(v.own_groups):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                inner = self._logits(self.word_out[c], self.word_shift[c], columns[:, a:b], far[c])
                picked[a:b] = inner[place[a:b], places[: b - a]]
                np.exp(inner, out=inner)
                np.add.reduce(inner, axis=0, out=sums[a:b])
        out = out.astype(np.float64)
        out[order] += picked - np.log(sums)
        return out / np.log(10) + v.inside[targets]

    @staticmethod
    def _far(weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether logits of these weights, or of each of several, may be too far from 0.

        No state is beyond -1..1, so weights and shifts bound the logits.
        """
        reach = np.abs(weights).sum(axis=-1, keepdims=True)
        return ((shift + reach).max(axis=(-2, -1)) > 60) | ((shift - reach).max(axis=(-2, -1)) < -60)

    @staticmethod
    def _logits(weights: np.ndarray, shift: np.ndarray, states: np.ndarray, far: bool) -> np.ndarray:
        """Logits that can be exponentiated: where they may be ``far`` from 0, each column's
        greatest is taken off."""
        logits = weights @ states
        logits += shift
        if far:
            logits -= logits.max(axis=0)
        return logits

    def _by_group(self, states: np.ndarray, targets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns with own words by class: their numbers, each class's first, places, states."""
        v = self.vocabulary
        order = np.argsort(group.astype(np.int16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(v.own_groups + 1)).tolist()
        order = order[: cuts[-1]]
        return order, cuts, v.place[targets[order]], np.ascontiguousarray(np.ascontiguousarray(states.T).take(order, axis=0).T)

    def gradients(
        self, states: np.ndarray, targets: np.ndarray, weight: float | np.ndarray
    ) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients of the states and of the output parameters; ``weight`` may go by column."""
        weight = np.broadcast_to(np.asarray(weight, states.dtype), len(targets))
        group = self.vocabulary.group[targets]
        p = self._logits(self.out, self.shift, states, self._far(self.out, self.shift))
        np.exp(p, out=p)
        p *= weight / p.sum(axis=0)
        p[group, np.arange(len(targets))] -= weight
        flow = self.out.T @ p
        word_out, word_shift = np.zeros_like(self.word_out), np.zeros_like(self.word_shift)
        order, cuts, place, columns = self._by_group(states, targets, group)
        own, back = weight[order], np.empty_like(columns)
        far, places = self._far(self.word_out, self.word_shift).tolist(), np.arange(len(order))
        for c in range(len(cuts) - 1):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                some, w = columns[:, a:b], own[a:b]
                q = self._logits(self.word_out[c], self.word_shift[c], some, far[c])
                np.exp(q, out=q)
                q *= w / np.add.reduce(q, axis=0)
                q[place[a:b], places[: b - a]] -= w
                np.matmul(q, some.T, out=word_out[c])
                np.add.reduce(q, axis=1, keepdims=True, out=word_shift[c])
                np.matmul(self.word_out[c].T, q, out=back[:, a:b])
        # Whole rows are gathered faster; columns without own words get the row of zeros.
        at = np.full(len(targets), len(order))
        at[order] = np.arange(len(order))
        flow += np.concatenate([back.T, np.zeros((1, len(back)), back.dtype)]).take(at, axis=0).T
        return flow, [p @ states.T, p.sum(axis=1, keepdims=True), word_out, word_shift]


class Lanes:
    """Documents laid end to end in lanes, read side by side in windows of words.

    In a lane they stand longest first, or as drawn.
    """

    def __init__(self, texts: list[np.ndarray], lanes: int, end: int, rng: np.random.Generator | None = None):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        lanes = max(1, min(lanes, len(texts)))
        load = [(0, k) for k in range(lanes)]
        members: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            total, k = heapq.heappop(load)
            members[k].append(d)
            heapq.heappush(load, (total + int(lengths[d]), k))
        members.sort(key=lambda m: -int(lengths[m].sum()))
        if rng is not None:
            members = [rng.permutation(m).tolist() for m in members]
        order = [d for m in members for d in m]
        close = np.array([end])
        self.target = np.concatenate([x for d in order for x in (texts[d], close)])
        self.before = np.concatenate([[end], self.target[:-1]])  # what stands before: a start is an end
        self.owner = np.repeat(order, lengths[order])
        self.sizes = np.array([int(lengths[m].sum()) for m in members])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.goes_on = (self.before != end).astype(np.float32)

    def windows(self, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(active lanes, places, inside) of each window of ``steps`` words."""
        for t in range(0, int(self.sizes[0]), steps):
            active = int(np.searchsorted(-self.sizes, -t))
            at = self.starts[:active] + np.arange(t, t + steps)[:, None]
            inside = at < self.starts[:active] + self.sizes[:active]
            yield active, np.minimum(at, self.starts[:active] + self.sizes[:active] - 1), inside


def train(model: Model, adam: Adam, texts: list[np.ndarray], rng: np.random.Generator, rate: float = 1.0) -> int:
    """Fit the model on all entries of the texts, window after window, state carried.

    Lanes run out one by one; their last windows are put together to steps of at least
    half the size.  Returns the number of entries read.
    """
    if not texts:
        return 0
    end = len(model.vocabulary.words)
    lanes = Lanes(texts, TRAIN_LANES, end, rng)
    least = TRAIN_LANES * STEPS_BACK // 2
    state, waiting, held, read = None, None, 0, 0
    for active, at, inside in lanes.windows(STEPS_BACK):
        kept: list = []
        goes_on = lanes.goes_on[at]
        symbols = model.vocabulary.symbol[lanes.before[at]]
        states, state = model.state.run(symbols, None if state is None else state[:, :active], goes_on, kept)
        flat = states.transpose(1, 0, 2).reshape(UNITS, -1)
        flow, outer = model.gradients(flat, lanes.target[at].ravel(), inside.ravel())
        flow = flow.reshape(UNITS, len(at), active).transpose(1, 0, 2)
        found = [*model.state.gradients(kept, flow, goes_on), *outer]
        waiting = found if waiting is None else [a + b for a, b in zip(waiting, found, strict=True)]
        held += int(inside.sum())
        if held >= least:
            adam.step([g / held for g in waiting], rate)
            read, waiting, held = read + held, None, 0
    if held:
        adam.step([g / least for g in waiting], rate)
    return read + held


def train_round(model: Model, docs: DataFrame, rate: float) -> Model:
    """The mean of the models that the tasks train on their ``docs``, by words."""
    vocabulary = model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own = copy.deepcopy(model)
        adam = Adam(own.parameters(), RATE)
        rng = np.random.default_rng(SEED)
        read = 0
        for texts in texts_of(batches):
            # Entries count from the end: the tail is the last of all, the end the one before.
            entries = [np.where(e < 0, len(vocabulary.words) + 1, e) for e in vocabulary.entries(texts)]
            read += train(own, adam, entries, rng, rate)
        if not read:
            return None
        weight = max(1, read >> 10)
        flat = np.concatenate([p.ravel() for p in own.parameters()]).astype(np.float64)
        return np.append(np.rint(flat * UNIT).astype(np.int64) * weight, [weight, read])

    found = summed(docs, run)
    if found is None:
        return model
    out = copy.deepcopy(model)
    flat, at = found[:-2] / (UNIT * float(found[-2])), 0
    for p in out.parameters():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    out.read += int(found[-1])
    return out


def score_texts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole text, the tail's inner part left out."""
    end = len(model.vocabulary.words)
    total = np.zeros(len(texts))
    if not texts:
        return total
    lanes = Lanes(texts, LANES, end)
    symbol = model.vocabulary.symbol[lanes.before]
    state = np.zeros((UNITS, len(lanes.sizes)), np.float32)
    for active, at, inside in lanes.windows(STEPS):
        states, state = model.state.run(symbol[at], state[:, :active], lanes.goes_on[at])
        flat = states.transpose(1, 0, 2).reshape(UNITS, -1)
        logs = model.log10(flat, lanes.target[at].ravel())
        total += np.bincount(lanes.owner[at].ravel(), np.where(inside.ravel(), logs, 0), len(total))
    return total


# -- scoring ---------------------------------------------------------------------------

def fit(docs: DataFrame, corpus: Corpus, most: int = SAMPLE) -> Model:
    rows = sample(docs, corpus.texts, most, "text", text=F.col("text"))
    words, firsts = hashed(pa.array([r.text for r in rows], pa.string()))
    texts = [words[a:b].view(np.int64) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    model = Model(make_vocabulary(corpus, texts, docs))
    model.start(corpus.counts.astype(float), max(0.0, corpus.tokens - corpus.texts - corpus.counts.sum()), corpus.texts)
    if not corpus.texts:
        return model
    drawn = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        own = [(k + j) % ROUNDS for j in range(PASSES)]
        model = train_round(model, docs.filter(drawn.isin(own)), 1.0 if k < ROUNDS - 1 else 0.25)
    return model


def _parts(docs: DataFrame, corpus: Corpus, model: Model) -> DataFrame:
    """Per row: what the head words give, and the tail words to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        known = np.log10(np.append(corpus.counts, [corpus.texts, 0]) + 0.1)
        for batch in slices(batches, size=SCORE_BYTES):
            words, firsts = hashed(batch.column("text"))
            words = words.view(np.int64)
            entries = model.vocabulary.numbers(words)
            tail = entries < 0
            entries = np.where(tail, len(corpus.words) + 1, entries)
            n = len(batch)
            owner = np.repeat(np.arange(n), np.diff(firsts))
            base = np.bincount(owner, np.where(tail, 0, known[entries]), n) + known[-2]
            score = score_texts(model, [entries[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)])
            missing = np.bincount(owner, tail, n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(missing)), pa.int32()), pa.array(words[tail]))
            tokens = np.diff(firsts) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(tokens.astype(np.int64)),
                 pa.array(tokens - missing), pa.array(base), pa.array(score), lists],
                ["row", "doc_id", "n_tokens", "n_head", "base", "score", "tail"],
            )
            row += n

    kinds = "row long, doc_id long, n_tokens long, n_head long, base double, score double, tail array<long>"
    return documents(docs, "doc_id", "text").mapInArrow(run, kinds)


def language_scores(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Counts, base score and model score of every row of ``docs``."""
    known = documents(docs, "doc_id", "text").filter(remainder(folds) != 0)
    counts = stage(word_counts(known), "counts")
    corpus = corpus_of(counts, known.select("doc_id").count())
    model = fit(known, corpus)
    parts = stage(_parts(docs, corpus, model), "parts")
    words = parts.select("row", F.explode("tail").alias("word"))
    c = F.coalesce("n", F.lit(0))
    tails = (
        words.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(c + 0.1)).alias("tail_base"), F.count("n").alias("tail_known"))
    )
    # Probabilities inside the tail: its words' counts, and one place for unseen words.
    tail_words = corpus.distinct - (corpus.texts > 0) - len(corpus.words)
    tail_mass = corpus.tokens - corpus.texts - int(corpus.counts.sum())
    tail_divisor = tail_mass + 0.1 * (tail_words + 1)
    missing = F.col("n_tokens") - F.col("n_head")
    tail_base = F.coalesce("tail_base", F.lit(0.0))
    base = F.col("base") + tail_base - F.col("n_tokens") * float(np.log10(corpus.divisor))
    score = F.col("score") + tail_base - missing * float(np.log10(tail_divisor)) if corpus.texts else base
    head_known = F.col("n_head") if corpus.texts else F.lit(0)
    return parts.drop("tail").join(tails, "row", "left").select(
        "doc_id", (remainder(folds) == 0).alias("held_out"), "n_tokens",
        (head_known + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
