import random
from collections import Counter

import numpy as np

from cohortweave.llm import probminhash as pm
from cohortweave.llm.common import read_table


def brute_classes(rows):
    """Least id of the class of each row, by all pairs of texts that share a shingle."""
    sets = [set(pm.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, shared = {}, Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j, i] += 1
            holders[x].append(i)
    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(repr((rows[i][0], least.get(find(i)))) for i in range(len(rows)))


def near_copies():
    random.seed(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for family in range(12):
        base = random.choices(words, k=random.choice([8, 60, 150]))
        for copy in range(random.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 6])):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((len(rows), " ".join(text)))
    chain = random.choices(words, k=100)
    for step in range(12):  # neighbours are near, the ends are not
        chain = chain[:3 * step] + random.choices(words, k=3) + chain[3 * step + 3:]
        rows.append((len(rows), " ".join(chain)))
    rows += [(900, "one two"), (901, "one  two "), (902, "two one"), (903, "same " * 400), (904, "same " * 390)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (3, "another text under an id that was used before it")]
    return rows


def test_classes_match_brute_force(frame):
    rows = near_copies()
    docs = frame("key string, doc_id long, text string, root int", [("k", *r, 1) for r in rows])
    found = pm.near_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in found) == brute_classes(rows)


def repeated_passages():
    """Pairs with nearly the same shingles, of which one text repeats a passage or lines many times."""
    random.seed(9)
    words = [f"w{i}" for i in range(100_000)]
    rows = []
    for share, times, new in [(2, 100, 0), (3, 20, 24), (3, 5, 48), (2, 3, 48)] * 5:
        base = random.choices(words, k=500)
        passage, lines = base[: len(base) // share], [" ".join(base[i : i + 25]) for i in range(0, 250, 25)]
        longer = " ".join(base + random.choices(words, k=new))
        text = " ".join([longer, *passage * times]) if len(rows) % 4 else "\n".join([longer, *lines * times])
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, text)]
    return rows


def test_repetition_loses_no_pair(frame):
    rows = repeated_passages()
    found = pm.near_duplicates(frame("doc_id long, text string", rows)).collect()
    wanted = brute_classes(rows)
    assert sum(repr((i, i)) in wanted for i, _ in rows) == len(rows) // 2  # each pair is a class
    assert sorted(repr((r.doc_id, r.class_id)) for r in found) == wanted


def test_classes_of_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = pm.near_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.class_id)) for r in found) == brute_classes(rows)


def test_keep_one(frame):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:59], "zz"])
    rows = [(1, a, "x"), (1, a, "x"), (2, b, "y"), (None, a, "n"), (None, None, "n"), (3, "", "e"), (4, "q r s", "q"),
            (4, "short", "q"), (5, "q r s", None), (None, "no id", "z"), (None, "no id", "z")]
    docs = frame("doc_id long, text string, class_id string", rows)
    kept = pm.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = [rows[i] for i in (0, 4, 5, 6, 7, 9)]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, wanted))
    assert pm.keep_one(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    random = np.random.default_rng(3)
    shared = random.integers(0, 2**63, 300).astype(np.uint64)
    own = random.integers(0, 2**63, (2, 100)).astype(np.uint64)
    weights = random.integers(1, 6, 400).astype(float)
    other = weights.copy()
    other[:150] *= 2
    sets = [(np.concatenate([shared, own[0]]), weights), (np.concatenate([shared, own[1]]), other)]
    x, y = (dict(zip(s.tolist(), w)) for s, w in sets)
    exact = sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys()
    )
    trials = []
    for salt in range(40):
        moved = [(s ^ np.uint64(salt * 977), w) for s, w in sets]
        registers = pm.sketch(moved)
        trials.append((registers[0] == registers[1]).mean())
    assert abs(np.mean(trials) - exact) < 0.02


def test_sketch_of_odd_sets():
    empty = np.empty(0, np.uint64)
    registers = pm.sketch([(empty, np.empty(0)), (np.array([7], np.uint64), np.ones(1))])
    assert (registers[0] == 0).all() and (registers[1] == 7).all()
    assert pm.bands_of(registers).shape == (2, pm.BANDS)
