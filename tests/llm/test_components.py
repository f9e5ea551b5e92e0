"""Components against union-find."""

import random

import pytest

from talkloom.llm.components import components


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("seed", range(4))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    n = [5, 60, 300, 0][seed]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] if n else [(i, i + 1) for i in range(120)]
    edges += [(1, 1), (None, 3), (3, None), *edges[:3]]
    found = components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert sorted(map(tuple, found)) == sorted(plain(edges).items())


def test_without_edges(spark):
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a int, b int"), "a", "b").collect() == []
