"""Components against union-find."""
import random

import pytest

from quarry.llm.graph import components


def brute(edges):
    top = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            top[q] = p
    return {x: find(x) for x in top}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    nodes = list(range(-60, 60))
    rng.shuffle(nodes)
    edges = {"random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)], "path": list(zip(nodes, nodes[1:], strict=False)),
             "star": [(nodes[0], x) for x in nodes] + [(7, 7), (nodes[0], nodes[1])], "empty": []}[kind]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == brute(edges) and len(got) == len({r["node"] for r in got})
