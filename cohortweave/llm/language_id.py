"""Language by rank-order profiles of character n-grams.

A profile is a ranked list of the most frequent 1- to 3-grams of lower-cased
letters inside words (``_`` marks a word's ends).  A document gets the language
whose profile has the least out-of-place distance to its own: the sum, over the
document's ranked n-grams, of how far each stands from its place in the profile,
or the profile's length if it is absent there.

Learning counts the n-grams of every labelled text where it lies, sums partial
counts by language and n-gram, and keeps the first places per language; only
these (``languages x PROFILE_PLACES`` rows) are collected, which a check of the number
of languages bounds.  Prediction needs no shuffle.  Texts of any length are
counted in blocks, so memory does not grow with a text.

Cases: a null text, or one without a letter, is ``und`` with score 0; a null
label teaches nothing; equal distances go to the first language by name; without
any labelled text every document is ``und``; repeated rows and equal ids are judged
row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.common import bound_batches, pick

PROFILE_PLACES = 400
DOCUMENT_PLACES = 300
#: More labels than this are taken for an error in the label column.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: What ``keep_known`` asks for: far below prose and even broken text of a known language.
LEAST_SCORE = 0.2

_BLOCK = 1 << 20
_FLUSH = 1 << 20
_END = 1  # code of a word's end; letters have their code point + 2
_LETTER = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters; filled once per process."""
    if not _LETTER[ord("a")]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _grams(text: str) -> np.ndarray:
    """All n-grams of a block of text; each packs up to three codes of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.int64)
    letter = _letters()[points]
    codes = np.where(letter, points.astype(np.int64) + 2, _END)
    codes = np.concatenate(([_END], codes, [_END]))
    # runs of other characters are one end of a word
    codes = codes[np.concatenate(([True], (codes[1:] != _END) | (codes[:-1] != _END)))]
    pairs = (codes[:-1] << 21) | codes[1:]
    threes = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[codes[1:-1] != _END]
    return np.concatenate((codes[codes != _END], pairs, threes))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, places = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(places, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts, block by block at word ends."""
    total = (np.empty(0, np.int64), np.empty(0, np.int64))
    start = 0
    text = text or ""
    while start < len(text):
        stop = start + _BLOCK
        while stop < len(text) and text[stop].isalpha() and stop < start + 2 * _BLOCK:
            stop += 1
        part = np.unique(_grams(text[start:stop]), return_counts=True)
        total = part if start == 0 else _merge([total, part])
        start = stop
    return total


def ranked(grams: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """The most frequent n-grams, ties by value."""
    return grams[np.lexsort((grams, -counts))[:places]]


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams per language, laid out for lookup by n-gram."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray  # (n-gram, language); the profile's length where absent
    length: int

    @staticmethod
    def of(ranked_grams: dict[str, list[int]], length: int = PROFILE_PLACES) -> Profiles:
        languages = sorted(ranked_grams)
        grams = np.unique(np.array([g for v in ranked_grams.values() for g in v], dtype=np.int64))
        ranks = np.full((len(grams), len(languages)), length, dtype=np.int32)
        for column, language in enumerate(languages):
            row = np.searchsorted(grams, np.array(ranked_grams[language], dtype=np.int64))
            ranks[row, column] = np.arange(len(row))
        return Profiles(languages, grams, ranks, length)

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 minus the distance's share of the largest distance."""
        own = ranked(*count_grams(text), DOCUMENT_PLACES)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        place = np.searchsorted(self.grams, own)
        place[place == len(self.grams)] = 0
        known = self.grams[place] == own
        ranks = np.where(known[:, None], self.ranks[place], self.length)
        away = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        distance = np.where(ranks == self.length, self.length, away).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.length * len(own)))


def learn(labelled: DataFrame, places: int = PROFILE_PLACES) -> Profiles:
    """Profiles from all rows of ``labelled`` (lang, text) with both present."""
    bound_batches(labelled.sparkSession)
    known = pick(labelled, "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                part = count_grams(text)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size > _FLUSH:
                    held = {k: [_merge(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > _FLUSH // 2:
                        yield from frames(held)
                        held, size = {}, 0
        yield from frames(held)

    def frames(held: dict) -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            grams, counts = _merge(parts)
            if len(grams):
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})

    counts = (
        known.mapInPandas(partial, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= places)
    # one more language than allowed is enough to see that there are too many
    rows = top.select("lang", "gram", "place").limit(places * MAX_LANGUAGES + 1).collect()
    if len({r.lang for r in rows}) > MAX_LANGUAGES or len(rows) > places * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column lang")
    found: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place)):
        found.setdefault(row.lang, []).append(row.gram)
    return Profiles.of(found, places)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.judge(t) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.select("*", judged(text).alias("_judged")).select(
        *docs.columns, "_judged.lang_pred", "_judged.score"
    )


def keep_known(docs: DataFrame, profiles: Profiles, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` (its columns as they are) without texts of no language or too far from all profiles."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    kept = predict(rows, profiles, "_text").filter(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    )
    return kept.select("_row.*")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
