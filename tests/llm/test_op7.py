import random
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.fixtures import CLASHING, documents, odd_rows, prose, rows_of, words
from waybill.llm import op7_mix as op


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([0, 1, 5, 7.5, 100, 1000]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        given = [0] * len(weights)
        for _ in range(seats if any(weights) else 0):
            given[max(range(len(weights)), key=lambda k: (weights[k] / (2 * given[k] + 1), -k))] += 1
        assert op.allot(np.array(weights, float), seats).tolist() == given


def test_targets_share_all_words_and_stop():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 5000]) for _ in range(rng.randrange(1, 12))]
        wanted = op.targets(sizes)
        assert abs(sum(wanted) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
        assert all(t <= 3 * s + 1e-9 for t, s in zip(wanted, sizes, strict=True))
        free = [t / (1 + k % 3) for k, (t, s) in enumerate(zip(wanted, sizes, strict=True)) if t < 3 * s]
        assert not free or max(free) - min(free) < 1e-6 * max(free)


def mixed(df):
    return op.mix(df.withColumn("size", op.size_of(F.col("text"))))


def test_taken_words_come_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 512)  # many shards of few words
    rows = [(k, prose(k, 20 + k % 90), "en", ["hot", "hot", "hot", "b", "c", "é", None][k % 7], 1) for k in range(900)]
    found = mixed(documents(spark, rows)).collect()
    assert len(found) == 900
    by_source = defaultdict(list)
    for r in found:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 3 * r.size
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in own) for s, own in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, op.targets([sizes[s] for s in order]), strict=True))
    for source, own in by_source.items():
        assert {(r.source_size, r.target) for r in own} == {(sizes[source], wanted[source])}
        shards = 1 + 2 * sizes[source] // op.SHARD_WORDS  # each may be off by a block
        assert abs(sum(r.taken for r in own) - wanted[source]) <= op.BLOCK * (shards + 1)
    again = mixed(documents(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_odd_rows(spark):
    df = documents(spark, odd_rows(), clashing=True)
    found = mixed(df)
    assert set(found.columns) == {*df.columns, "source_size", "target", "taken", "size"}
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    assert all(r.taken == 0 for r in rows if not words(r.text))
    assert all(r.row == CLASHING.index("row") for r in rows)
    plain = rows_of(found.select("doc_id", "text", "lang", "source", "n_chars"))
    assert plain == rows_of(df.select("doc_id", "text", "lang", "source", "n_chars"))


def test_empty_tables(spark):
    assert mixed(documents(spark, [])).count() == 0
    only = mixed(documents(spark, [(1, None, "en", None, 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


def test_texts_of_the_mix_hold_the_taken_words(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 512)
    rows = [(k, prose(k, 20 + k % 90), "en", ["hot", "hot", "hot", "b", "c", "é", None][k % 7], 1) for k in range(300)]
    df = documents(spark, odd_rows() + rows)
    counts = sorted(((r.doc_id, r.text, r.taken) for r in mixed(df).collect()), key=repr)
    sized = df.withColumn("size", op.size_of(F.col("text")))
    found = op.mix(sized, spans=True).withColumn("cut", op.cut_text(F.col("text"))).collect()
    assert sorted(((r.doc_id, r.text, r.taken) for r in found), key=repr) == counts
    for r in found:
        own = words(r.text)
        assert all(0 <= s.start < s.end <= r.size and s.end - s.start <= op.BLOCK for s in r.spans)
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))
        assert words(r.cut) == own * r.rounds + [w for s in r.spans for w in own[s.start : s.end]]
        assert len(words(r.cut)) == r.taken
    assert any(r.rounds > 1 for r in found) and any(0 < r.taken < r.size for r in found)
    last = pipeline.mixed(spark, df, "").collect()
    assert {(r.doc_id, len(words(r.text)), len(r.text)) for r in last} == {(r.doc_id, r.taken, r.n_chars) for r in last}


def test_long_text_is_split_into_words_once(spark):
    words = [f"w{k}" for k in range(100_000)]
    spans = [(k, k + 16) for k in range(0, 100_000, 64)]
    df = spark.createDataFrame([(" ".join(words), 1, spans)], "text string, rounds long, spans array<struct<start: long, end: long>>")
    start = time.perf_counter()
    got = df.select(op.cut_text(F.col("text")).alias("t")).first().t
    assert time.perf_counter() - start < 30  # once for every span it would take minutes
    assert got.split("\n") == [" ".join(words), *(" ".join(words[a:b]) for a, b in spans)]


def test_the_plan_reaches_the_jvm_without_python_workers(spark, monkeypatch):
    frames, broadcast = [], F.broadcast
    monkeypatch.setattr(op.F, "broadcast", lambda df: frames.append(df) or broadcast(df))
    rows = [(k, f"s{k % 3}", 5 * k) for k in range(30)]
    assert op.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).count() == 30
    lineage = frames[0]._jdf.toJavaRDD().toDebugString()
    assert "Python" not in lineage and frames[0].count() == 3
