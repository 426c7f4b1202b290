"""Components against union and find."""

import random

import pytest

from flipjoin.llm.components import components


def plain(edges):
    root = {}

    def of(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[of(a)] = of(b)
    groups = {}
    for x in list(root):
        groups.setdefault(of(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(shape)
    edges = {"chain": [(i, i + 1) for i in range(150)] + [(1000, 1001)], "star": [(0, i) for i in range(1, 200)],
             "random": [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]}[shape]
    df = spark.createDataFrame([*edges, *edges[:5], (edges[0][1], edges[0][0])], "a long, b long").repartition(3)
    found = components(df).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["label"], set()).add(r["node"])
    assert len(found) == sum(map(len, groups.values()))
    assert {frozenset(g) for g in groups.values()} == {g for g in plain(edges) if len(g) > 1}
    assert all(label in g for label, g in groups.items())


def test_nothing_to_join(spark):
    """Loops and edges with a null end say nothing."""
    df = spark.createDataFrame([(1, 1), (None, 2), (3, None), (None, None)], "a long, b long")
    assert components(df).count() == 0 and components(df.limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(4, 5)], "a long, b long"))
    assert {r["node"] for r in components(more).collect()} == {4, 5}
