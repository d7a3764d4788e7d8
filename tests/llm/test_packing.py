import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortweave.llm import chunks, packing
from cohortweave.llm.common import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(PATH)
    loaded.encode_special_tokens = True
    return loaded


def test_cut():
    assert packing.cut(5) == [(0, 5)]
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)]
    assert packing.cut(2060) == [(0, 12), (12, 1024), (1036, 1024)]


def test_plan_fills_sequences_without_gap_or_overlap():
    random.seed(5)
    for trial in range(20):
        capacity = random.choice([8, 64, 1024])
        counts = {random.randint(1, capacity): random.randint(1, 40) for _ in range(random.randint(1, 60))}
        sequences = defaultdict(list)
        ranks = defaultdict(list)
        for length, rank, number, first, offset in packing.plan_slots(counts, capacity):
            ranks[length] += range(rank, rank + number)
            for s in range(first, first + number):
                sequences[s].append((offset, length))
        assert {k: len(v) for k, v in ranks.items()} == counts
        assert all(sorted(v) == list(range(counts[k])) for k, v in ranks.items())
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_plan_is_best_fit_decreasing():
    random.seed(6)
    counts = {k: random.randint(1, 5) for k in random.sample(range(1, 101), 40)}
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in room if r >= length]
            if fitting:
                room.remove(min(fitting))
                room.append(min(fitting) - length)
            else:
                room.append(100 - length)
    slots = packing.plan_slots(counts, 100)
    assert max(first + number for _, _, number, first, _ in slots) == len(room)


def test_plan_size_does_not_follow_the_counts():
    random.seed(7)
    counts = {k: random.randint(1, 10**10) for k in range(1, 1025)}
    slots = packing.plan_slots(counts)
    assert len(slots) < 20_000
    used = max(first + number for _, _, number, first, _ in slots)
    assert used <= 1.02 * sum(k * n for k, n in counts.items()) / 1024


def test_added_tokens_get_the_ids_of_the_library(monkeypatch):
    loaded = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        encoder = packing._encoder(file.read())
    token = "<|endoftext|>"
    texts = ["a <|endoftext|> b", token, token * 3, f" {token} ", f"a{token}b\n{token}\n", f"x  {token}  y", "<|endoftext|", ""]
    random.seed(4)
    texts.append("".join(random.choices([token, " ", "  ", "word", " and", "\n", "<|", "7"], k=3000)))
    for size in (1 << 20, 1, 7):  # blocks end beside added tokens too
        monkeypatch.setattr(chunks, "_BLOCK", size)
        for text in texts:
            ids = np.frombuffer(packing.encode(encoder, text), "<u4").tolist()
            assert ids == loaded.encode(text, add_special_tokens=False).ids
    assert loaded.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_documents_are_packed_whole(spark, frame, tokenizer):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = frame(
        "doc_id long, text string",
        [(None, "no id"), (-1, None), (-2, ""), (-3, "same"), (-3, "same"), (-4, "long text here " * 2000)],
    )
    both = docs.union(odd)
    out = packing.pack(both, PATH).collect()
    wanted = []
    for row in both.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        for number, (start, length) in enumerate(packing.cut(len(ids))):
            part = np.array(ids[start : start + length], dtype="<u4").tobytes()
            wanted.append((repr(row.doc_id), number, start, length, zlib.crc32(part), part))
    got = [(repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out]
    assert sorted(got) == sorted(wanted)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * sum(r.length for r in out) / 1024 + 1
    assert packing.pack(both.limit(0), PATH).count() == 0
