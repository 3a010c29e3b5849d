"""Components of link tables against union-find."""

import random

import pytest

from ledgerloom.llm.components import components


def _plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def _random(n, m, seed):
    draw = random.Random(seed)
    return [(draw.randrange(-n, n), draw.randrange(-n, n)) for _ in range(m)]


CASES = {
    "empty": [],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (-(2**63), 2**63 - 1)],
    "chain": [(i, i + 1) for i in range(60)],
    "shuffled chain": list(zip(p := random.Random(1).sample(range(200), 80), p[1:], strict=False)),
    "star around its largest": [(500, i) for i in range(300)],
    "star around a middle node": [(250, i) for i in range(500)] + [(250, 9000), (9000, 8999)],
    "sparse": _random(300, 250, 2),
    "dense": _random(60, 400, 3),
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_union_find(spark, name):
    links = CASES[name]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in found} == _plain(links)
    assert len(found) == len(_plain(links))
