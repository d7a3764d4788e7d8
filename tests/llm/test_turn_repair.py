"""Turn repair against a search over all edits, streamed in small batches and through scratch files."""

import hashlib
import heapq
import random
import re

import pytest
from conftest import rows_of

from cohortweave.llm import turn_repair

BLANK = re.compile("[^\x20\x09-\x0d]")
REPAIRED = re.compile("(s?(ua)+)?")
OPEN = re.compile("s?(ua)*u?")


def best_edits(kinds):
    """(cost, audit) by cheapest-first search; ``kinds`` are (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(kinds) and REPAIRED.fullmatch(out):
            return cost, audit
        if (i, out, audit) in seen:
            continue
        seen.add((i, out, audit))
        ways = [(2, "I", i, out + r) for r in "ua"]
        if i < len(kinds):
            initial, must_go, truncated = kinds[i]
            ways.append((3, "D", i + 1, out))
            if not must_go:
                ways += [(2 + truncated, "R", i + 1, out + r) for r in "ua"] + [(truncated, "K", i + 1, out + initial)]
        for more, letter, j, seq in ways:
            if OPEN.fullmatch(seq) and cost + more <= 3 * len(kinds):
                heapq.heappush(heap, (cost + more, audit + letter, j, seq))


def plain(rows):
    """Summary of one conversation: rows (turn, role, text), in order."""
    seen, faults, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for turn, role, text in rows:
        fault = ""
        if not BLANK.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        kinds.append((role[:1] or "-", fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = best_edits(kinds)
    lines, i, due = [], 0, "user"
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role, text = ("", "") if letter == "I" else rows[i][1:]
        i += letter != "I"
        if letter != "K":
            role = due
        if not (letter == "K" and role[:1] == "s"):
            due = "assistant" if due == "user" else "user"
        lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[0] + b[0] for a, b in zip(kinds, kinds[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *faults.values(),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", "umpire"]
    texts = ["Yes.", "No!", "cut", " \t\n", "", "Why? ", "so\x85", "end. ", "ü?", "a\x0b."]
    found = {}
    for conv in range(160):
        n = draw.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])
        turns = sorted(draw.sample(range(-3, 14), n))
        weights = [5, 4, 2, 1, 1, 1]
        found[conv] = [(t, draw.choices(roles, weights)[0], draw.choice(texts) if draw.random() < 0.6 else f"t{t}.") for t in turns]
        if n > 2 and conv % 7 == 0:
            found[conv][0] = (None, *found[conv][0][1:])
    return found


@pytest.mark.parametrize("journal_bytes", [turn_repair.JOURNAL_BYTES, 100])
def test_equals_search_over_all_edits(spark, frame, conversations, journal_bytes):
    rows = [(c, t, r, x, True) for c, turns in conversations.items() for t, r, x in turns]
    rows += [(c, 5, "user", "gone", False) for c, turns in conversations.items() if not turns]
    random.Random(1).shuffle(rows)
    df = frame("conv_id bigint, turn bigint, role string, text string, here boolean", rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "3")
    try:
        got = {r[0]: tuple(r[1:]) for r in turn_repair.repair(df, "here", journal_bytes).collect()}
        turns = turn_repair.repaired_turns(df, "here", journal_bytes).collect()
    finally:
        spark.conf.unset(key)
    assert got == {c: plain(turns) for c, turns in conversations.items()}
    for conv, summary in got.items():
        mine = sorted((t["place"], t["edit"], t["role"], t["text"]) for t in turns if t["conv_id"] == conv)
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert "".join(e for _, e, _, _ in mine) == summary[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in mine).encode()).hexdigest() == summary[7]


def test_steps_equal_search_on_long_conversations():
    draw = random.Random(5)
    steps = turn_repair.Steps()
    for _ in range(300):
        kinds = [(draw.choice("suat"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randint(1, 9))]
        talk = turn_repair.Conversation("c", steps, 1 << 20)
        for i, (initial, fault) in enumerate(kinds):
            talk.add(str(i), initial, "x", turn_repair.INITIALS.find(initial) % 4, fault)
        expected = best_edits([(i, f in (turn_repair.BLANK, turn_repair.DUPLICATE), f == turn_repair.TRUNCATED) for i, f in kinds])
        assert talk._edits() == expected
    assert len(steps.back) < 1000  # situations repeat, whatever the conversations


def test_a_giant_conversation_streams(frame):
    n = 30_000
    rows = [(1, i, "user", f"text {i}.") for i in range(n)]
    got = turn_repair.repair(frame("conv_id bigint, turn bigint, role string, text string", rows), journal_bytes=50_000).first()
    assert (got.cost, got.illegal, got.gaps) == (n, n - 1, 0)
    assert got.audit == "KR" * (n // 2)


def test_nulls_ties_clashing_names_and_no_rows(frame):
    schema = "conv_id string, turn int, role string, text string, Text string, initial int, _live boolean, fault int"
    extra = ("x", 9, False, 9)
    rows = [
        (None, None, None, None, *extra),
        (None, 1, "user", "A.", *extra),
        (None, 1, "assistant", "B.", *extra),
        ("c", 1, "user", "same.", *extra),
        ("c", 1, "user", "same.", *extra),
    ]
    got = rows_of(turn_repair.repair(frame(schema, rows)), "conv_id", "gaps", "blank", "duplicate", "cost", "audit")
    # equal turns go by role: the assistant speaks first
    assert got == [(None, 0, 1, 0, 7, "DIKKI"), ("c", 0, 0, 1, 5, "KDI")]
    assert turn_repair.repair(frame(schema, [])).collect() == []
    assert turn_repair.repaired_turns(frame(schema, [])).collect() == []


def test_damage_draws_by_checksum(frame):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)]
    rows += [(None, None, None, None)]
    got = turn_repair.damage(frame("conv_id bigint, turn bigint, role string, text string", rows)).collect()
    expected = []
    for c, t, r, x in rows:
        c_, t_ = (" " if v is None else str(v) for v in (c, t))
        d = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        r, x = r or " ", x or " "
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(d, x)
        expected += [(c, t, "user" if d == 4 else r, x, d != 0)] * (2 if d == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
