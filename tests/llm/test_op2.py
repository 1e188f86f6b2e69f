import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.llm.fixtures import SMALL, documents, odd_rows
from waybill.llm import op2_language as op
from waybill.llm.recurrent import Gated
from waybill.llm.sampling import sample_of_each


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    layer = Gated(3, 5, rng)
    for name in ("table", "inner", "bias"):
        setattr(layer, name, getattr(layer, name).astype(np.float64) * 0.5)
    symbols, weight = rng.integers(0, 5, (6, 4)), rng.standard_normal((6, 3, 4))
    goes_on = (rng.random((6, 4)) < 0.7).astype(float)

    def value():
        return float((layer.run(symbols, np.zeros((3, 4)), goes_on)[0].astype(np.float64) * weight).sum())

    kept = []
    layer.run(symbols, np.zeros((3, 4)), goes_on, kept)
    for parameter, gradient in zip(layer.parameters(), layer.gradients(kept, weight, goes_on), strict=True):
        for at in list(np.ndindex(parameter.shape))[::3]:
            old = parameter[at]
            parameter[at] = old + 1e-3
            up = value()
            parameter[at] = old - 1e-3
            down = value()
            parameter[at] = old
            assert abs((up - down) / 2e-3 - gradient[at]) < 2e-2


def test_windows_cover_every_byte_once():
    cuts = np.array([0, 0, 5, 5 + 3 * op.WINDOW, 5 + 3 * op.WINDOW + 1])
    starts, lengths, owner = op._windows(np.zeros(cuts[-1], np.uint8), cuts)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths, strict=True)])
    assert sorted(covered) == list(range(cuts[-1])) and owner.tolist() == [1, 2, 2, 2, 3]


def test_held_out_accuracy(spark):
    found = op.query(spark, SMALL).collect()
    given = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    lang = {r["doc_id"]: r["lang"] for r in given}
    assert len(found) == len(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(spark):
    network = op.train([b"the cat and the dog", "où est le café".encode()] * 3, ["en", "fr"] * 3, steps=5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op.languages(documents(spark, odd_rows(), True), network).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 14))
    assert all(got[k][0] in ("en", "fr") for k in (None, 5, 7, 8, 12, -4))
    assert got[10] == got[11]


def test_nothing_to_learn_from(spark):
    nothing = documents(spark, [(1, "words", None, "a", 1), (3, "words", None, "a", 1)])
    assert op.fit(nothing) is None
    assert {r.lang_pred for r in op.languages(nothing, None).collect()} == {"und"}
    empty = documents(spark, [])
    assert op.languages(empty, op.fit(empty)).count() == 0


def test_pooling_does_not_depend_on_neighbours():
    network = op.train([b"the cat and the dog", "où est le café".encode()] * 3, ["en", "fr"] * 3, steps=5)
    texts = ["a b c" * 100, "été", "x"]
    names, scores = op.Reader(network)(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        alone = op.Reader(network)(pa.array([text]))
        assert alone[0] == [name] and abs(alone[1][0] - score) < 1e-5


def test_signs_that_are_no_letters(spark):
    assert not any(op.has_letter(t) for t in (None, "", "² ½ ① 12", "!?", "３")) and all(map(op.has_letter, ("x", "é", "漢", "1a")))


def test_any_split_of_a_table_gives_equal_rows(spark):
    network = op.train([b"the cat and the dog", "où est le café".encode()] * 3, ["en", "fr"] * 3, steps=5)
    rows = odd_rows()
    found = []
    for parts in (1, 2, 13):
        df = documents(spark, rows).repartition(parts, "n_chars", "doc_id")
        found.append(sorted(((r.doc_id, r.lang_pred, r.score) for r in op.languages(df, network).collect()), key=repr))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(other, found[0], strict=True))


def test_sample_draws_from_every_language(spark):
    rows = [(k, f"text {k}", "en" if k % 100 else "xx", "a", 1) for k in range(1, 3001)]
    got = sample_of_each(documents(spark, rows), "lang", 20, "lang", "doc_id", text=F.col("text"))
    assert Counter(r.lang for r in got) == {"en": 20, "xx": 20}
    again = sample_of_each(documents(spark, rows).repartition(11), "lang", 20, "lang", "doc_id", text=F.col("text"))
    assert got == again
