import random

import pytest

from postmill.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(60)],
        [(i, (i + 1) % 30) for i in range(30)],
        [(0, i) for i in range(1, 200)] + [(500, 501), (7, 7), (None, 3), (900, 900)],
        [tuple(random.Random(9).sample(range(60), 2)) for _ in range(3)] + [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(40)],
        [],
    ],
)
def test_components_equal_union_find(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == brute(edges)
