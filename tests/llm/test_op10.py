import random

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tests.llm.fixtures import SMALL, documents, odd_rows, rows_of
from waybill.llm import op10_tokens as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def test_random_texts():
    rng = random.Random(1)
    alphabet = list("abcdefg  ,.'12\n\t\x1c\x85 é漢🙂SstT") + ["<|endoftext|>", "'ll", "the ", " a"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += ["", " ", "a ", " a", "a  b", "a \n", "\n\n a", "<|endoftext|>", "x<|endoftext|> y", "aaaa" * 50, "aaa, bbb."]
    assert op.Counter(PATH).counts(texts) == expected(texts)


def test_very_long_pretokens():
    rng = random.Random(2)
    texts = ["a" * 9000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(9000)), " " * 5000, "=" * 7000]
    assert op.Counter(PATH).counts(texts) == expected(texts)
    merges = op.load(PATH)
    short = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)]
    assert op.ragged_counts(merges, short).tolist() == [op.long_count(merges, t) for t in short]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 40)
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist()[:30]
    counter = op.Counter(PATH)
    assert [counter.counts([t])[0] for t in texts] == expected(texts)


def test_whole_table(spark):
    given = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op.query(spark, SMALL).collect()}
    counts = expected([r["text"] for r in given])
    assert found == {r["doc_id"]: (len(r["text"].encode()), n, n > 1024) for r, n in zip(given, counts, strict=True)}


def test_odd_rows(spark):
    rows = odd_rows()
    found = op.token_counts(documents(spark, rows, clashing=True), PATH)
    counts = expected([r[1] for r in rows])
    wanted = [(r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, counts, strict=True)]
    assert rows_of(found) == sorted(wanted, key=repr)
    assert op.token_counts(documents(spark, []), PATH).count() == 0
