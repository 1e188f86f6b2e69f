import math

import numpy as np

from waybill.llm import op6_vector_duplicates as op

KINDS = "vec_id long, embedding array<float>, label int, key long, n long, rep long"


def brute(rows):
    ok = [
        v is not None and i is not None and lab is not None and len(v) > 0
        and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for i, v, lab, *_ in rows
    ]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= op.COSINE:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None), default=None)
        label = low if ok[k] else i
        out.append((i, links[k], label, i is None or label == i))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KINDS).repartition(3)


def got(df):
    return sorted(map(tuple, op.vector_duplicates(df).collect()), key=repr)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, number = [], 0
    for group in range(14):
        centre = rng.standard_normal(32)
        for spread in [0, 0, *rng.choice([0.05, 0.15, 0.2], rng.integers(0, 30))]:
            vector = (centre + spread * rng.standard_normal(32)) * rng.choice([1e-6, 1.0, 1e6])
            rows.append((number * 7 % 1000, [float(x) for x in vector.astype(np.float32)], group % 3))
            number += 1
    one = rows[0][1]
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * 32, 1), (2003, [None, *one[1:]], 0), (2004, [float("nan"), *one[1:]], 0),
        (2005, [float("inf"), *one[1:]], 0), (2006, one, None), (2006, one, None), (None, one, 0), (2007, one[:5], 0),
        (2008, one[:5], 0), rows[3], rows[3],
    ]
    assert got(table(spark, rows)) == brute(rows)


def test_a_bucket_of_many_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in (centre + 0.08 * rng.standard_normal(16)).astype(np.float32)], 1) for k in range(700)]
    found = got(table(spark, rows))
    x = op.unit(np.array([r[1] for r in rows], np.float32))
    links = (x @ x.T >= op.COSINE).sum(axis=1) - 1
    assert [r[1] for r in sorted(found)] == links.tolist()
    assert {r[2] for r in found} == {0}


def test_empty_table(spark):
    assert got(table(spark, [])) == []


def test_a_key_is_the_same_in_any_company():
    rng = np.random.default_rng(4)
    units = op.unit(rng.standard_normal((300, 24)))
    labels = rng.integers(0, 3, 300)
    together = op.bucket_keys(units, labels)
    for k in range(0, 300, 17):
        assert (op.bucket_keys(units[k : k + 1], labels[k : k + 1])[0] == together[k]).all()


def test_a_chance_meeting_of_lengths_loses_no_link(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 0.1], 3: [1.0, 0.0, 0.0], 4: [1.0, 0.0, 0.1], 5: [0.0, 1.0]}
    rows = [(7, 0, 0, 0, 0, rep, 1, 1, bytearray(np.array(v).tobytes())) for rep, v in vectors.items()]
    kinds = "key long, i int, j int, block int, t int, rep long, label long, copies long, raw binary"
    met = op._compared(spark.createDataFrame(rows, kinds).coalesce(1), 0.93, 4, 4).collect()
    assert {(r.rep, r.n, r.root) for r in met} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)}
