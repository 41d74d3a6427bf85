import random

import pytest

from kgloom.operators.components import connected_components


@pytest.mark.parametrize("core", [0, 10, 1000])
def test_against_union_find(spark, core):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(10, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (101, 100), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), core_links=core).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in up} and len(got) == len(up)


def test_strings_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in connected_components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(df.limit(0)).collect() == []
