"""Components of small graphs against union-find."""

import random

import pytest

from wavelattice.llm.components import components


def brute(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(n) if find(x) != x}


CHANCE = random.Random(5)
GRAPHS = {
    "none": [],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "stars already": [(1, 0), (2, 0), (4, 3)],
    "path": [(i, i + 1) for i in range(59)],
    "random": [(CHANCE.randrange(60), CHANCE.randrange(60)) for _ in range(45)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_match_union_find(spark, name):
    edges = GRAPHS[name]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.a for r in rows})
    assert {r.a: r.root for r in rows} == brute(60, edges)
