import hashlib
import random
import re

from tests.llm.fixtures import LOWER, documents, odd_rows, prose, rows_of
from waybill.llm import op9_decontaminate as op

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = tokens(text)
        if item is not None and w:
            size = min(op.WINDOW, len(w))
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = tokens(text), set(), set()
        for size in range(1, op.WINDOW + 1):
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    found |= got
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((bool(hit), doc_id, digest, len(hit), len(found), len(w)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(6)
    items = [(k, prose(500 + k, rng.choice([3, 9, 10, 11, 40]), 60)) for k in range(30)]
    items += [(30, None), (None, "words of nobody here"), (31, ""), (32, "..."), (33, "Zwölf"), (5, prose(999, 12)), (34, items[3][1])]
    rows = odd_rows()
    for k in range(120):
        text = prose(2000 + k, 80, 60)
        if k % 3 == 0:
            w = tokens(items[k % 30][1])
            a = rng.randrange(len(w))
            text += " -- " + ", ".join(w[max(0, a - 8) : a + 12]).upper() + "; zwölf? ZWÖLF!"
        rows.append((1000 + k, text, "en", "a", 1))
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def test_hits_equal_brute_force(spark, monkeypatch):
    rows, items = fixture()
    found = op.contamination(documents(spark, rows, clashing=True), bench(spark, items)).drop("n_near_items")
    assert rows_of(found) == brute(rows, items)
    # Many shards answer as one does.
    parts = op.contamination(documents(spark, rows), bench(spark, items), shard_bytes=600)
    assert rows_of(parts.drop("n_near_items")) == brute(rows, items)


def test_nearby_rare_terms(spark):
    items = [(1, "alpha beta gamma delta epsilon common common common words of the test go here")]
    rows = [
        (1, "alpha x beta y gamma z delta", "en", "a", 1), (2, "common words", "en", "a", 1),
        (3, "alpha " + "far " * 60 + "beta " + "far " * 60 + "gamma", "en", "a", 1), (4, items[0][1], "en", "a", 1),
    ]
    found = {r.doc_id: (r.n_hit > 0, r.n_near_items) for r in op.contamination(documents(spark, rows), bench(spark, items)).collect()}
    assert found[4] == (True, 1) and found[2] == (False, 0) and found[3] == (False, 0)


def test_empty_tables(spark):
    rows = odd_rows()
    for items in ([], [(1, None)], [(None, "some words")]):
        assert rows_of(op.contamination(documents(spark, rows), bench(spark, items)).drop("n_near_items")) == brute(rows, [])
    assert op.contamination(documents(spark, []), bench(spark, [(1, "some words")])).count() == 0


def brute_near(rows, items):
    """Pairs of documents and items, word by word."""
    texts = {}
    for item, text in items:
        if item is not None and text is not None:
            texts.setdefault((str(item), text), tokens(text))
    counts = {}
    for _, text, *_ in rows:
        for w in tokens(text):
            counts[w] = counts.get(w, 0) + 1
    out = set()
    for (item, _), own in texts.items():
        terms = sorted(set(own), key=lambda w: (counts.get(w, 0), int(op.hashed(op.pa.array([w]), op.ALNUM)[0][0])))[: op.NEAR_TERMS]
        if len(terms) < op.NEAR_TERMS:
            continue
        for doc_id, text, *_ in rows:
            w = tokens(text)
            for k in (k for k, x in enumerate(w) if x == terms[0]):
                near = w[max(0, k - op.NEAR_WORDS + 1) : k + op.NEAR_WORDS]
                if all(t in near for t in terms[1:]):
                    out.add((doc_id, item))
    return sorted(out, key=repr)


def test_proximity_equals_brute_force(spark):
    rows, items = fixture()
    for size in (op.SHARD_BYTES, 600):
        found = op.nearby_items(documents(spark, rows, clashing=True), bench(spark, items), shard_bytes=size)
        assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr) == brute_near(rows, items) != []


def test_shards_pass_one_at_a_time(spark):
    import types

    assert isinstance(op.benchmark_shards(bench(spark, [(1, "a b c")])), types.GeneratorType)


def test_documents_pass_no_second_python_step(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    found = op.contamination(docs, bench)
    rows = {r.doc_id: r for r in found.collect()}
    assert [(rows[k].n_words, rows[k].n_hit, rows[k].contaminated) for k in (1, 2, None)] == [(3, 2, True), (0, 0, False), (2, 0, False)]
    assert rows[2].items_sha256 == op.hashlib.sha256(b"").hexdigest() and rows[2].n_items == 0
    # Above the join of documents and answers none stands, so no stage holds two.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan[: plan.index("Join")]
