import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortweave.llm import language_id as li
from cohortweave.llm.common import read_table

SMALL = "/root/testdata/sf0.01"


def brute_counts(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    grams = {}
    line = "_" + "_".join(words) + "_"
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != "_" and not (n == 3 and g[1] == "_"):
                grams[g] = grams.get(g, 0) + 1
    return grams


def packed(gram):
    value = 0
    for c in gram:
        value = (value << 21) | (1 if c == "_" else ord(c) + 2)
    return value


def test_grams_match_brute_force():
    random.seed(3)
    texts = ["The cat, the CAT!", "é", "übergröße 12 wörter", "a1b2 c", "日本 語", "x" * 50]
    texts += ["".join(random.choice("abé ,") for _ in range(200)) for _ in range(20)]
    for text in texts:
        grams, counts = li.count_grams(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == {packed(g): n for g, n in brute_counts(text).items()}


def test_blocks_of_long_texts(monkeypatch):
    text = "some words of prose that go on, and on; " * 300
    whole = li.count_grams(text)
    monkeypatch.setattr(li, "_BLOCK", 100)
    parts = li.count_grams(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_rank_distance():
    profiles = li.Profiles.of({"x": [packed("a"), packed("b")], "y": [packed("b"), packed("a")]}, 2)
    # own order of "ab": grams a, b, then pairs and threes that no profile has
    grams = li.ranked(*li.count_grams("ab"), li.DOCUMENT_PLACES).tolist()
    away = {k: sum(abs(v.index(g) - i) if g in v else 2 for i, g in enumerate(grams)) for k, v in
            {"x": [packed("a"), packed("b")], "y": [packed("b"), packed("a")]}.items()}
    best = min(away, key=away.get)
    assert profiles.judge("ab") == (best, 1 - away[best] / (2 * len(grams)))


def test_held_out_accuracy(spark):
    docs = read_table(spark, SMALL, "documents")
    fold = li.fold()
    judged = li.predict(docs, li.learn(docs.filter(fold != 0))).withColumn("held", fold == 0).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in judged)
    held = [r for r in judged if r.held]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in judged)


def test_odd_rows(frame):
    train = frame("lang string, text string", [("en", "the and of the"), ("fr", "le et de la"), (None, "zzz"), ("de", None)])
    profiles = li.learn(train)
    assert profiles.languages == ["en", "fr"]
    docs = frame(
        "doc_id long, text string, lang_pred string, score string",
        [(1, None, "a", "b"), (2, "", "a", "b"), (None, "123 !", "a", "b"), (4, "the of", "a", "b"), (4, "the of", "a", "b")],
    )
    kept = li.keep_known(docs, profiles, 0.0).collect()
    assert [(r.doc_id, r.text, r.lang_pred) for r in kept] == [(4, "the of", "a")] * 2
    narrow = li.predict(docs.select("doc_id", "text"), profiles).collect()
    assert [(r.lang_pred, r.score) for r in narrow[:3]] == [("und", 0.0)] * 3
    none = li.learn(train.limit(0))
    assert {r.lang_pred for r in li.predict(docs.select("text"), none).collect()} == {"und"}
    assert li.predict(docs.select("doc_id", "text").limit(0), profiles).count() == 0
    assert docs.select(F.coalesce(li.fold() == 0, F.lit(False)).alias("h")).filter("h").count() >= 0
