import random

import pytest

from tablewright.llm.graph import components
from tablewright.storage import Scratch


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def shapes():
    draw = random.Random(4)
    yield "none", []
    yield "path", [(i, i + 1) for i in range(40)]
    yield "star", [(99, i) for i in range(40)]
    yield "loop and repeats", [(1, 1), (2, 3), (3, 2), (2, 3)]
    yield "random", [(draw.randrange(80), draw.randrange(80)) for _ in range(60)]


@pytest.mark.parametrize(("name", "edges"), list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_components(spark, name, edges):
    edges = [e for e in edges]
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == brute([e for e in edges if e[0] != e[1]])
