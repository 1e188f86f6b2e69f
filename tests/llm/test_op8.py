import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tests.llm.fixtures import SMALL, documents, odd_rows, prose, words
from waybill.llm import op8_language_model as op


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute(rows):
    """n_tokens, n_known, train_tokens and base_score of every (doc_id, text)."""
    tokens = [[*words(text), None] for _, text in rows]
    counts = Counter(t for (d, _), own in zip(rows, tokens, strict=True) if not held_out(d) for t in own)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (len(own), sum(counts[t] > 0 for t in own), total,
         sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own))
        for own in tokens
    ]


def agrees(found, rows):
    given = sorted(((d, t) for d, t in rows), key=repr)
    found = sorted(found, key=lambda r: (repr(r.doc_id), r.n_tokens))
    expected = sorted(zip(given, brute(given), strict=True), key=lambda x: (repr(x[0][0]), x[1][0]))
    assert len(found) == len(expected)
    for r, ((doc_id, _), (n, known, total, base)) in zip(found, expected, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (doc_id, n, known, total, held_out(doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_counts_and_base_score_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "HEAD", 60)  # most words go through the join
    rows = odd_rows() + [(100 + k, prose(k, 30), "en", "a", 1) for k in range(150)]
    found = op.language_scores(documents(spark, rows, clashing=True)).collect()
    agrees(found, [(r[0], r[1]) for r in rows])


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    found = op.query(spark, SMALL).collect()
    given = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    agrees(found, [(r["doc_id"], r["text"]) for r in given])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    counts = np.sort(np.random.default_rng(0).integers(1, 50, 70))[::-1].astype(np.int64)
    corpus = op.Corpus(int(counts.sum()) + 100 + 20, 20, 90, np.arange(70, dtype=np.int64) * 3, counts)
    texts = [np.arange(k, k + 40, dtype=np.int64) for k in range(0, 160, 8)]
    return corpus, op.Model(op.make_vocabulary(corpus, texts))


def test_probabilities_add_up_to_one(monkeypatch):
    monkeypatch.setattr(op, "OWN", 40)
    corpus, model = small_model()
    model.start(corpus.counts.astype(float), 100.0, 20.0)
    entries = np.arange(72)  # all head words, the end and the tail as a whole
    for _ in range(3):
        state = np.random.default_rng(1).standard_normal((op.UNITS, 1)).astype(np.float32)
        p = 10 ** model.log10(np.repeat(state, 72, axis=1), entries)
        assert abs(p.sum() - 1) < 1e-4


def test_output_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(op, "OWN", 40)
    _, model = small_model()
    rng = np.random.default_rng(2)
    for name in ("out", "shift", "word_out", "word_shift"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    states, targets = rng.standard_normal((op.UNITS, 9)), np.array([0, 5, 20, 39, 45, 69, 70, 71, 3])
    flow, gradients = model.gradients(states, targets, 1.0)

    def loss():
        return -float(model.log10(states, targets).sum()) * math.log(10)

    arrays = [states, model.out, model.shift, model.word_out]
    for array, gradient in zip(arrays, [flow, *gradients[:3]], strict=True):
        for at in list(np.ndindex(array.shape))[::41]:
            old = array[at]
            array[at] = old + 1e-4
            up = loss()
            array[at] = old - 1e-4
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-4 - gradient[at]) < 1e-3


def test_state_is_carried_through_whole_texts(monkeypatch):
    monkeypatch.setattr(op, "OWN", 40)
    _, model = small_model()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 70, n) for n in (0, 1, 5, 90, 33, 700, 2)]
    together = op.score_texts(model, texts)
    for text, score in zip(texts, together, strict=True):
        symbols = model.vocabulary.symbol[np.append(70, text)]
        states, _ = model.state.run(symbols[:, None])
        alone = model.log10(states[:, :, 0].T.copy(), np.append(text, 70)).sum()
        assert abs(alone - score) < 1e-3 * max(1, abs(alone))


def test_no_training_text_and_no_text(spark):
    held = next(k for k in range(1000) if held_out(k))
    found = op.language_scores(documents(spark, [(held, "some words", "en", "a", 1)])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in found] == [(3, 0, 0)]
    assert found[0].score == found[0].base_score and found[0].base_score == 0.0
    assert op.language_scores(documents(spark, [])).count() == 0


def test_every_training_word_is_trained_on(spark, monkeypatch):
    monkeypatch.setattr(op, "TRAIN_LANES", 4)
    monkeypatch.setattr(op, "SAMPLE", 20)
    rows = [(k, prose(k, 5 + k % 60 + 3000 * (k == 7)), "en", "a", 1) for k in range(400)]
    df = documents(spark, rows).select("doc_id", "text")
    for part in (df.filter("doc_id < 100"), df):
        corpus = op.corpus_of(op.word_counts(part), part.count())
        model = op.fit(part, corpus, op.SAMPLE)
        assert model.read == corpus.tokens
        again = op.fit(part, corpus, op.SAMPLE)
        assert all(np.array_equal(a, b) for a, b in zip(model.parameters(), again.parameters(), strict=True))


def test_lanes_run_out_one_by_one():
    _, model = small_model()
    texts = [np.zeros(n, np.int64) for n in (500, 3, 70, 0, 9)]
    read = op.train(model, op.Adam(model.parameters(), op.RATE), texts, np.random.default_rng(0))
    assert read == sum(len(t) + 1 for t in texts)


def test_classes_far_from_zero_are_found_apart(monkeypatch):
    monkeypatch.setattr(op, "OWN", 64)
    _, model = small_model()
    model.word_out[1, 3] = 50.0  # its logits overflow unless each column's greatest is taken off
    assert model._far(model.word_out, model.word_shift).tolist() == [False, True]
    assert not model._far(model.out, model.shift)
    states = np.random.default_rng(4).uniform(0.5, 1, (op.UNITS, 64)).astype(np.float32)
    own = np.flatnonzero(model.vocabulary.group[:-2] < 2)
    found, group, place = model.log10(states, own), model.vocabulary.group[own], model.vocabulary.place[own]
    for k, (g, p) in enumerate(zip(group, place, strict=True)):
        outer = model.out.astype(float) @ states[:, k] + model.shift[:, 0]
        inner = model.word_out[g].astype(float) @ states[:, k] + model.word_shift[g, :, 0]
        exact = outer[g] - np.logaddexp.reduce(outer) + inner[p] - np.logaddexp.reduce(inner)
        assert math.isclose(found[k], exact / math.log(10), rel_tol=1e-4, abs_tol=1e-4)


def test_head_words_are_found_in_chains():
    rng = np.random.default_rng(5)
    spread = rng.integers(-(1 << 63), 1 << 63, 5000)
    for words in (np.unique(spread), np.arange(-70, 70) * 3, np.arange(40) << 50, np.array([7])):
        v = op.Vocabulary(words.astype(np.int64), *(np.zeros(0, np.int64),) * 4, 0, 0, 0)
        asked = np.concatenate([words, words + 1, [-1, 0, 7]]).astype(np.int64)
        at = np.minimum(np.searchsorted(v.words, asked), len(words) - 1)
        expected = np.where(v.words[at] == asked, at, -1)
        assert np.array_equal(v.numbers(asked), expected)
        assert v.__getstate__()["chains"] is None
        parts = v.entries([asked[:3], asked[:0], asked[3:]])
        assert [len(x) for x in parts] == [3, 0, len(asked) - 3] and np.array_equal(np.concatenate(parts), expected)
    assert op.Vocabulary(np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 4, 0, 0, 0).entries([]) == []


def test_a_word_votes_once_for_each_text():
    texts = [np.array([3, 3, 0, -1, 3]), np.array([3, 1]), np.array([-1])]
    found = op.votes(texts, np.eye(1, 4, dtype=np.float32), 5).reshape(6, op.THEMES)
    assert found.sum(axis=1).tolist() == [1, 1, 0, 2, 0, 3] and not found[:, 1:].any()


def test_word_counts_hold_little_beside_the_words():
    """A slice's bytes are not widened all at once, which costs time and memory."""
    import tracemalloc

    import pyarrow as pa

    from waybill.llm.words import hashed

    texts = pa.array([f"w{k} " * 1000 for k in range(1000)])
    size = sum(b.size for b in texts.buffers() if b)
    tracemalloc.start()
    try:
        words, _ = hashed(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == 1_000_000 and most < 10 * size
