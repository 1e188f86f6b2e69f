import random

import pytest

from waybill.llm.graph import components, roots


def reached(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(8)
    links = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "chain": [(k, k + 1) for k in range(40)][::-1],
        "star": [(7, k) for k in range(60)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (5, 5)],
    }[shape]
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in components(df).select("node", "component").collect()} == reached(links)


def test_roots_of_a_forest(spark):
    rng = random.Random(9)
    links = [(k, rng.randrange(max(0, k - 3), k)) for k in range(1, 80)] + [(200, 150), (201, 200)]
    found = roots(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in found.select("node", "component").collect()} == reached(links)
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0
