"""The Z-fast trie against a plain one that holds every prefix as a tuple of its turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from cohortweave.llm import prefix_trie as trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """Strings of (role, text) per conversation, as the contract rebuilds them."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    found = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        found[conv] = own.get(conv - conv % 20, [])[:h] + own[conv][h:]
    return found


def plain(strings):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in strings.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(trie_words(node[-1][1])) if node else 0
    return sorted(
        (
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node],
             saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
            for node, convs in members.items()
        ),
        key=lambda row: [(v is not None, v) for v in row],
    )


def trie_words(text):
    return [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]


def invented(seed, convs, most):
    """Conversations that share beginnings, end within others and repeat, some missing and some long."""
    draw = random.Random(seed)
    rows = []
    for conv in convs:
        n = draw.choice([1, 1, 2, 3, 4, most])
        for turn in range(n):
            text = draw.choice(["a b", "a  b c", "x"]) if draw.random() < 0.9 else f"only {conv}"
            rows.append((conv, turn, draw.choice(["user", "assistant"]) if turn else "user", text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches", [(1.0,), (0.1, 0.4, 1.0)])
def test_equals_plain_trie(frame, batches):
    rows = invented(1, [c for c in range(140) if c % 20 or c < 100] + [100_000, 70_001], 20)
    got = trie.nodes(trie.rebuild(trie.turns(frame(SCHEMA, rows))), batches)
    assert got.columns == list(COLUMNS)
    strings = rebuilt(rows)
    assert any(not s for s in strings.values())  # one is left without turns
    assert rows_of(got) == plain(strings)


def test_long_edges_chains_and_copies(frame, monkeypatch):
    monkeypatch.setattr(trie, "EDGE_BLOCK", 7)
    monkeypatch.setattr(trie, "MEMBER_BITS", 2)
    long = [("user", f"turn {i}") for i in range(67)]
    strings = {0: long, 1: long[:40], 2: long[:40] + [("user", "else")], 3: long[:1], 40: [], 45: []}
    strings |= {c: long[: c - 100] for c in range(101, 167)}  # each ends within the next
    strings |= {c: long[:40] + [("user", "else")] for c in range(1000, 1300)}
    rows = [(c, i, r, t) for c, turns in strings.items() for i, (r, t) in enumerate(turns)]
    places = trie.turns(frame(SCHEMA, rows))
    empty = frame("conv_id bigint", [(40,), (45,)])
    got = trie.nodes(places.unionByName(empty, allowMissingColumns=True), (0.2, 1.0))
    assert rows_of(got) == plain(strings)


def test_search_finds_the_deepest_stored_prefix(frame):
    rows = [(c, i, "user", f"{c % 3 if i > c % 11 else 'same'}") for c in range(80) for i in range(c % 23 + 1)]
    everyone = trie.prefixes(trie.turns(frame(SCHEMA, rows))).cache()
    ends = everyone.filter("next_p IS NULL")
    lines = everyone.join(ends.groupBy("depth", "p", "q").agg(F.min("conv_id").alias("conv_id")).select("conv_id"), "conv_id", "left_semi").cache()
    stored = trie.build(lines.filter("conv_id < 40"), (0.3, 1.0)).cache()
    for r in stored.collect():
        fattest = max(range(r.above + 1, r.depth + 1), key=lambda d: (d & -d))
        assert r.handle == fattest
    found = {r.conv_id: r.l for r in trie.locate(lines, lines.filter("next_p IS NULL AND conv_id >= 40"), stored).collect()}
    named = {(r.depth, r.p, r.q) for r in stored.collect()}
    ways = defaultdict(list)
    for r in lines.filter("conv_id >= 40").collect():
        ways[r.conv_id].append((r.depth, r.p, r.q))
    assert found and found == {c: max([d for d, p, q in way if (d, p, q) in named], default=0) for c, way in ways.items()}


def test_nulls_ties_clashing_names_and_no_rows(frame):
    schema = SCHEMA + ", Text string, depth int, p int, place int"
    extra = ("other", 1, 2, 3)
    rows = [(None, 0, "user", "lost", *extra), (20, None, None, None, *extra), (20, 1, "user", "b", *extra), (20, 1, "user", "b", *extra)]
    got = rows_of(trie.nodes(trie.rebuild(trie.turns(frame(schema, rows)))))
    assert got == plain({20: [("", ""), ("user", "b"), ("user", "b")]})
    assert trie.nodes(trie.rebuild(trie.turns(frame(schema, [])))).collect() == []
