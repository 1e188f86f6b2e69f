import random

import numpy as np

from tests.llm.fixtures import documents, odd_rows, prose, words
from waybill.llm import op3_near_duplicates as op


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=op.WORDS, percent=op.PERCENT):
    """Rows by comparing all pairs, whatever the bands."""
    sets = {}
    for doc_id, text, *_ in rows:
        sets.setdefault(doc_id, []).append(frozenset(shingles(text, k)))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    out = []
    for doc_id, text, *_ in rows:
        label = None if doc_id is None else find(doc_id)
        out.append((doc_id, len(shingles(text, k)), label, doc_id is None or label == doc_id))
    return sorted(out, key=repr)


def edited(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
    return " ".join(w)


def got(df, **options):
    return sorted(map(tuple, op.near_duplicates(df, **options).collect()), key=repr)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows, number = odd_rows(), 100
    for seed in range(12):
        text = prose(100 + seed, rng.choice([20, 60, 150]))
        for changes in [0, 0, *[rng.randrange(5) for _ in range(rng.randrange(12))]]:
            rows.append((number, edited(text, changes, rng).title(), "en", "a", 1))
            number += 1
    # A chain: neighbours are linked, its ends are not.
    chain = prose(77, 300).split()
    for step in range(8):
        chain[step * 30 : step * 30 + 12] = [f"c{step}x{k}" for k in range(12)]
        rows.append((number + 50 - step, " ".join(chain), "en", "a", 1))
    assert got(documents(spark, rows, clashing=True)) == brute(rows)


def test_other_words_and_threshold(spark):
    rng = random.Random(4)
    text = prose(9, 80)
    rows = [(k, edited(text, k % 7, rng), "en", "a", 1) for k in range(30)]
    assert got(documents(spark, rows), words=5, percent=80) == brute(rows, 5, 80)


def test_empty_tables(spark):
    assert got(documents(spark, [])) == []
    assert got(documents(spark, [(1, None, "en", "a", 0)])) == [(1, 0, 1, True)]


def test_bands_miss_less_than_asked():
    for percent in (70, 80, 85, 95):
        bands, rows = op.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= op.BAND_MISS and bands * rows <= 200


def test_posterior_bound_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    steps = op.least_matches(85, 192)
    left = np.zeros((20_000, 192), np.uint32)
    right = (rng.random(left.shape) > 0.85).astype(np.uint32)
    assert len(op.survives(left, right, steps)) == len(left)
    assert len(op.survives(left, (rng.random(left.shape) > 0.4).astype(np.uint32), steps)) < 20
    assert [least for _, least in steps] == sorted(least for _, least in steps)


def just_under(n, seed):
    """Texts of one origin of which each two share somewhat less than the threshold."""
    rng = random.Random(seed)
    base = prose(40, 400, 10**9).split()
    texts = []
    for k in range(n):
        w = list(base)
        for place in rng.sample(range(0, 400, 4), 11):
            w[place] = f"own{k}x{place}"
        texts.append(" ".join(w))
    return texts


def test_forest_of_a_block_equals_all_pairs():
    texts = just_under(60, 1) + just_under(60, 2)[:20] + [prose(5, 80)] * 2
    sets = [np.array(sorted(hash(s) for s in shingles(t, 3)), np.int64) for t in texts]
    sketch = op.Sketch(192)
    signs = np.stack([sketch(np.unique(s.view(np.uint64))) for s in sets])
    for percent in (75, 85):
        steps = op.least_matches(percent, 192)
        links = op.forest(signs, sets, np.arange(len(sets)), None, steps, percent)
        assert len(links) < len(sets)
        one = {i: {i} for i in range(len(sets))}
        two = {i: {i} for i in range(len(sets))}

        def join(groups, a, b):
            both = groups[a] | groups[b]
            for x in both:
                groups[x] = both

        for a, b in links:
            join(one, a, b)
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= percent * len(x | y):
                    join(two, a, b)
        assert one == two


def test_near_copies_under_the_threshold_make_no_pair_rows(spark, monkeypatch):
    counts = {}

    def counted(df, label="stage"):
        out = stage(df, label)
        counts[label] = counts.get(label, 0) + out.count()
        return out

    stage = op.stage
    monkeypatch.setattr(op, "stage", counted)
    sizes = {}
    for n in (150, 600):
        counts.clear()
        rows = [(k, t, "en", "a", 1) for k, t in enumerate(just_under(n, 8))]
        found = got(documents(spark, rows))
        assert len(found) == n
        sizes[n] = dict(counts)
    for label, many in sizes[600].items():
        assert many <= 6 * max(sizes[150].get(label, 0), 40), (label, sizes)


def test_whole_sets_are_made_in_one_pass_of_python(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(op, "stage", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None), (None, "x"), (5, "")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    for packed in (False, True):
        found = {r.doc_id: len(r.shingles) for r in op._full_sets(ids, docs, 3, packed).collect()}
        assert found == {1: 2, 2: 2, 3: 0} if not packed else found == {1: 16, 2: 16, 3: 0}
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
