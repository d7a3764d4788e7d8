"""Scores against a plain model in dictionaries; the coded trie against a dictionary of n-grams."""

import math
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from cohortweave.llm import ngram_model as lm
from cohortweave.llm.elias_fano import Sequence, Trie


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + ["</s>"]


def plain(docs, order):
    """Rows of the query, from (doc_id, text)."""
    fold = [None if d is None else zlib.crc32(str(d).encode()) % 10 for d, _ in docs]
    counts = Counter()
    for f, (_, text) in zip(fold, docs):
        if f:
            seq = ["<s>", *tokens(text)]
            counts[("<s>",)] += 1
            for i in range(1, len(seq)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        counts[tuple(seq[i - n + 1 : i + 1])] += 1
    words = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(words.values()), len(words)
    rows = []
    for f, (doc_id, text) in zip(fold, docs):
        seq = ["<s>", *tokens(text)]
        base = score = 0.0
        for i in range(1, len(seq)):
            single = (words.get(seq[i], 0) + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(single)
            p = min(single, 1.0)
            for k in range(2, order + 1):
                gram = tuple(seq[i - k + 1 : i + 1]) if i - k + 1 >= 0 else None
                context = counts[gram[:-1]] if gram else 0
                seen = counts[gram] / (context + 2.0) if gram and counts[gram] else 0.0
                if seen:
                    seen = 10 ** (-min(round(-math.log10(seen) * 24), 254) / 24)
                p = min(seen + 2.0 / (context + 2.0) * p, 1.0)
            score += math.log10(p)
        known = sum(words.get(t, 0) > 0 for t in seq[1:])
        rows.append((doc_id, f == 0, len(seq) - 1, known, n, base, score))
    return rows


def same(got, expected):
    def order(r):
        return (r[0] is not None, r[0] or 0, r[2], r[5])

    got, expected = sorted(map(tuple, got), key=order), sorted(expected, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "ÄÖ", "x\x0by", "a\x00b", " ", "-"]
    docs = [(i, " ".join(draw.choices(vocabulary, range(len(vocabulary), 0, -1), k=draw.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, "w1 w2 w3"), (7, "w1 w2 w3 w4"), (7, "w1 w2 w3 w4")]
    # one text much longer than a block, of few words, and one of unseen words
    docs += [(300, "\n".join(draw.choices(["w0", "w1", "w2"], k=4000))), (10, "never heard before")]
    return docs


@pytest.mark.parametrize("order, block_tokens", [(3, 97), (3, 1 << 20), (2, 1000), (4, 50), (1, 500)])
def test_equals_plain_model(frame, texts, monkeypatch, order, block_tokens):
    monkeypatch.setattr(lm, "SHARD_WORDS", 40)
    monkeypatch.setattr(lm, "SHARD_GRAMS", 3000)
    df = frame("doc_id bigint, text string", texts)
    got = lm.score(df, order, block_tokens)
    assert got.columns == "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    same(got.collect(), plain(texts, order))


def test_clashing_names_no_rows_and_no_training(frame):
    schema = "doc_id bigint, text string, Text string, row int, train boolean, block int"
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held_out, "a b", "x", 1, True, 2), (None, "a", "x", 1, True, 2)]
    got = sorted(map(tuple, lm.score(frame(schema, rows)).collect()), key=repr)
    assert got == [(held_out, True, 3, 0, 0, 0.0, 0.0), (None, False, 2, 0, 0, 0.0, 0.0)]
    assert lm.score(frame(schema, [])).collect() == []


def test_pieces_of_long_texts_keep_words():
    text = " Aé bcdefghi\x0bj  k\r\nlmnopq\x1c \x85\u2003İÀ r\x00 \t"
    cut = list(lm.pieces(text, 5))
    assert len(cut) > 3 and [ends for _, ends in cut] == [False] * (len(cut) - 1) + [True]
    codes, lengths, words = lm.coded([*[p for p, _ in cut], b"", b" ", b"K"])
    assert [words[c].decode() for c in codes] == [*tokens(text)[:-1], "k"]
    assert lengths.sum() == len(codes) and lengths[-3:].tolist() == [0, 0, 1]
    assert list(lm.pieces(None, 5)) == [(b"", True)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_texts_over_many_pieces_and_blocks(frame, texts, monkeypatch, order):
    monkeypatch.setattr(lm, "PIECE_BYTES", 40)
    got = lm.score(frame("doc_id bigint, text string", texts), order, 130)
    same(got.collect(), plain(texts, order))


@pytest.mark.parametrize("n, most, order", [(0, 5, 2), (1, 5, 3), (4096, 10**7, 1), (30_000, 60, 3), (20_000, 10**6, 4)])
def test_trie_finds_what_a_dictionary_holds(n, most, order):
    draw = np.random.default_rng(n)
    grams = np.unique(draw.integers(1, most, (n, order)), axis=0).astype(np.uint64).reshape(-1, order)
    codes, counts = draw.integers(1, 256, len(grams)), draw.integers(1, 1 << 40, len(grams))
    asked = np.unique(np.concatenate([grams[::2], draw.integers(1, most + 2, (500, order)).astype(np.uint64)]), axis=0)
    with tempfile.TemporaryFile() as file:
        trie = Trie.build(grams, codes, counts, file)
        places = {tuple(g): i for i, g in enumerate(grams.tolist())}
        assert trie.find(asked).tolist() == [places.get(tuple(g), -1) for g in asked.tolist()]
        assert (trie.codes == codes).all() and (trie.counts == counts).all()
        if n == 30_000:  # levels are compact: well below eight bytes a gram beside code and count
            assert file.seek(0, 2) < 13 * len(grams)


@pytest.mark.parametrize("values", [[0], [5, 5, 5, 9], list(range(0, 90_000, 7)), [1, 2, 1 << 62], [3] * 9000])
def test_sequences(values):
    file = tempfile.TemporaryFile()
    held = np.array(values, np.uint64)
    parts = Sequence.write(held, file)
    file.flush()
    coded = Sequence(np.memmap(file, np.uint8, "r"), **parts)
    assert (coded.access(np.arange(len(held))) == held).all()
    asked = np.unique(np.concatenate([held, held + np.uint64(1), np.zeros(1, np.uint64)]))
    positions, found = coded.successor(asked)
    expected = np.searchsorted(held, asked)
    assert positions.tolist() == expected.tolist()
    inside = expected < len(held)
    assert (found[inside] == held[expected[inside]]).all() and (found[~inside] == 0).all()


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([0, 255, 256]), np.array([1 << 63], np.uint64)]
    back = lm.unpacked(lm.packed(*arrays), 3)
    assert [b.tolist() for b in back] == [a.tolist() for a in arrays]


def test_distinct_rows_of_wide_ids():
    random = np.random.default_rng(6)
    for top, n in [(50, 500), (1 << 40, 500), (1 << 23, 3000), (1 << 63, 1), (1 << 63, 0)]:
        some = random.integers(0, top, 40).astype(np.uint64)
        columns = [random.choice(some, n) for _ in range(3)]
        first, number = lm._distinct(columns)
        rows = list(zip(*[c.tolist() for c in columns]))
        distinct = sorted(set(rows))
        assert [rows[i] for i in first] == distinct
        assert [distinct[i] for i in number] == rows
