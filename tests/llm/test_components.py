"""Components against union-find, in one task and in many."""

import random

import pytest

from plumbline.llm.common import Scratch
from plumbline.llm.components import components


@pytest.mark.parametrize("task_edges", [1_000_000, 60, 7])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape, task_edges):
    rng = random.Random(6)
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(300)] + [(500, 500)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "none": [],
    }[shape]
    if shape == "chain" and task_edges == 7:
        edges = edges[:60]
    rng.shuffle(edges)
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(table, Scratch(spark, "test"), "c", task_edges).collect()}
    assert got == {i: find(i) for i in parent}
