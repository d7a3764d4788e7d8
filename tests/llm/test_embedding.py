import numpy as np

from cohortweave.llm import embedding_dedup as ed


def brute(rows):
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i, (_, v, label) in enumerate(rows):
        for j, (_, u, other) in enumerate(rows[:i]):
            if label is None or label != other or not v or not u or len(v) != len(u):
                continue
            a, b = (np.array([np.nan if x is None else x for x in w], float) for w in (v, u))
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                a, b = a / abs(a).max(), b / abs(b).max()
                near[i, j] = near[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    root = list(range(n))
    for _ in range(n):
        for i, j in zip(*np.nonzero(near)):
            root[i] = root[j] = min(root[i], root[j])
    ids = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(repr((rows[i][0], int(near[i].sum()), ids[root[i]], rows[i][0] == ids[root[i]])) for i in range(n))


def data():
    random = np.random.default_rng(4)
    centres = random.standard_normal((6, 16))
    rows = []
    for i in range(150):
        spread = [0.05, 0.2, 0.35][i % 3]
        rows.append((i, (centres[i % 6] + spread * random.standard_normal(16)).round(3).tolist(), i % 2))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1)]
    rows += [(304, [float("inf")] + [1.0] * 15, 1), (305, [], 1), (306, rows[0][1], None), (307, rows[0][1][:8], 0)]
    rows += [(None, rows[2][1], 0), (None, None, None), (3, rows[3][1], 1), (308, [7e300, 7e300], 0), (309, [1e-300, 1e-300], 0)]
    return rows


def test_links_match_brute_force(frame):
    rows = data()
    vectors = frame("vec_id long, embedding array<double>, label int, key string, n int", [(*r, "k", 1) for r in rows])
    for tile in (2048, 20):
        found = ed.linked(vectors, tile=tile).collect()
        assert sorted(repr(tuple(r)) for r in found) == brute(rows)


def test_empty_table(frame):
    assert ed.linked(frame("vec_id long, embedding array<float>, label int", [])).count() == 0


def test_recall_at_the_threshold():
    random = np.random.default_rng(9)
    base = ed.unit(random.standard_normal((600, 64)))
    side = random.standard_normal((600, 64))
    side = ed.unit(side - (side * base).sum(1, keepdims=True) * base)
    near = 0.931 * base + np.sqrt(1 - 0.931**2) * side
    left, right = ed.links_within(np.concatenate([base, near]), np.zeros(1200), False)
    found = set(zip(left.tolist(), right.tolist()))
    assert sum((i, 600 + i) in found for i in range(600)) / 600 > 0.99


def test_collisions_are_window_members():
    random = np.random.default_rng(1)
    a, b = random.standard_normal((30, 7)), random.standard_normal((40, 7))
    wanted = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.4).sum(axis=2)
    assert (ed.collisions(a, b, 0.4) == wanted).all()
    assert ed.calibrated_count(40, 0.5) > ed.calibrated_count(40, 0.9999) > 0
