import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cohortweave.llm import bpe
from cohortweave.llm.common import read_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

TEXTS = [
    "", "a", "don't  we'll \n x \t y", "  a  b ", "x  y", "a b c" * 10, "0" * 700, "a" * 1500, "ab" * 900,
    " " * 900, "\n" * 700 + "x", "日本語" * 300, "é" * 300 + "\x1c x\x85 y", "ha" * 400 + " " + "thethe" * 100,
    "<|endoftext|> is text", "😀😀 naïve space", "--- === ###" * 40,
]


@pytest.fixture(scope="module")
def loaded():
    with open(RANKS, "rb") as file:
        return bpe.load(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(loaded):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=loaded[0].ranks, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text), dtype="<u4").tobytes()


def test_ids_match_the_library(loaded, library):
    random.seed(11)
    texts = TEXTS + ["".join(random.choice("aeth \nn1!é") for _ in range(random.randint(1, 700))) for _ in range(200)]
    texts.append("".join(random.choice("abcdefgh") for _ in range(3000)))
    for text, ids in zip(texts, loaded[1].encode(texts)):
        assert ids == packed(library, text), text[:50]
        assert loaded[0].decode(ids) == text.encode()


def test_long_pieces_equal_the_matrix_way(loaded, monkeypatch):
    random.seed(2)
    pieces = [bytes(random.choice(b"abthe") for _ in range(random.randint(257, 500))) for _ in range(20)]
    pieces += [b"a" * 300, b"ab" * 150, b"aab" * 120]
    alone = loaded[0].encode_pieces(pieces)
    monkeypatch.setattr(bpe, "MATRIX_WIDTH", 512)
    assert all(np.array_equal(a, b) for a, b in zip(alone, loaded[0].encode_pieces(pieces)))


def test_blocks_of_long_texts(loaded, library, monkeypatch):
    monkeypatch.setattr("cohortweave.llm.chunks._BLOCK", 50)
    text = "Some words,  with double spaces\nand lines \n of every kind don't matter. " * 9
    assert list(loaded[1].encode([text, None, text])) == [packed(library, text), b"", packed(library, text)]


def test_round_trip_of_documents(spark, frame, library):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = frame("doc_id long, text string", [(None, "x y"), (-1, None), (-2, ""), (-3, "same"), (-3, "same")])
    both = docs.union(odd)
    out = bpe.decode(bpe.encode(both, RANKS, PATTERN), RANKS, PATTERN).collect()
    texts = sorted((repr(r.doc_id), (r.text or "").encode()) for r in both.collect())
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in out) == texts
    assert sorted(bytes(r.ids) for r in out) == sorted(packed(library, t.decode()) for _, t in texts)
    assert bpe.encode(both.limit(0), RANKS, PATTERN).count() == 0
    clash = frame("ids long, doc_id long, Text string, text string", [(1, 2, "no", "yes")])
    assert bytes(bpe.encode(clash, RANKS, PATTERN).collect()[0].ids) == packed(library, "yes")
