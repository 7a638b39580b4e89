import random

import pytest

from textloom.llm import components as C


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(1)
    order = rng.sample(range(1000), 1000)
    return {
        "ascending path": [(i, i + 1) for i in range(1000)],
        "shuffled path": list(zip(order, order[1:])),
        "star": [(500, i) for i in range(1000)],
        "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(500)],
        "loops, repeats, nulls": [(3, 3), (4, 4), (4, 5), (4, 5), (None, 4), (9, None)],
        "none": [],
    }


@pytest.mark.parametrize("name", graphs())
def test_against_union_find(spark, monkeypatch, name):
    steps, staged = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, label: steps.append(label) or staged(df, label))
    edges = graphs()[name]
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(edges) and len(got) == len(brute(edges))
    assert steps.count("parents") <= 10 and len(steps) <= 60  # rounds grow with the logarithm of the graph, and so do their steps
