import random

import pytest

from cohortweave.llm.components import connected_components


def brute(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return sorted(root.items())


random.seed(1)
GRAPHS = {
    "empty": [],
    "pair": [(2, 1)],
    "star": [(5, i) for i in range(5)] + [(i, 5) for i in range(6, 40)],
    "path": [(i, i + 1) for i in range(40)],
    "zigzag": [(1, 3), (3, 4), (4, 2)],
    "random": [(random.randrange(300), random.randrange(300)) for _ in range(200)],
    "repeated": [(1, 2), (2, 1), (1, 2), (3, 3), (3, 2)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(frame, name):
    found = connected_components(frame("a long, b long", GRAPHS[name]))
    wanted = [(n, r) for n, r in brute([e for e in GRAPHS[name] if e[0] != e[1]])]
    assert sorted(map(tuple, found.collect())) == wanted
