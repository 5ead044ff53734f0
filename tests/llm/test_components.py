import random

import pytest

from blocklens.llm.common import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2)], [(i, i + 1) for i in range(60)], [(60 - i, 59 - i) for i in range(60)],
    [(0, i) for i in range(1, 80)], [(99, i) for i in range(80)],
    [(random.Random(7).randint(0, 0) + a, b) for a, b in [(5, 3), (3, 9), (-4, 9), (8, 7), (7, 8)]]])
def test_shapes(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_random_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(edges)
