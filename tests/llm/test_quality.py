import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortweave.llm import quality_ledger as ql


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    repeated = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a b c a b c a b c", "é \x0b ü\x85x | <tag> 50% #1",
    "line\nline\n\n  \nline ", "x " * 3000, "the same words again " * 700, "no break space", "😀 😀 😀 😀",
]


def test_measures_match_brute_force(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "a b c a b c")]
    found = ql.ledger(frame("doc_id long, text string", rows)).collect()
    got = sorted((repr((r.doc_id, *[r[m] for m in ql.MEASURES[:5]])) for r in found))
    assert got == sorted(repr((i, *brute(t))) for i, t in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t|é", max_size=60), min_size=1, max_size=30))
def test_measures_of_any_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in ql.ledger(frame).collect():
        assert tuple(row[m] for m in ql.MEASURES[:5]) == brute(texts[row.doc_id])


def test_policies_and_ablation(frame):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean), (2, "too short"), (3, "again and again " * 40), (4, clean.upper() + " X" * 9), (5, None)]
    ledger = ql.ledger(frame("doc_id long, text string", rows)).cache()
    base = {r.doc_id for r in ledger.filter(ql.passes(F.col("failed"), ql.BASE_POLICY)).collect()}
    kept = {r.doc_id for r in ledger.filter(ql.passes(F.col("failed"))).collect()}
    assert base == {1, 4} and kept == {1}
    lines = {(r.policy, r.rule): r for r in ql.ablation(ledger, [ql.BASE_POLICY, ql.DEFAULT_POLICY]).collect()}
    assert lines["base", "short"].n_failed == 2 and lines["base", "short"].n_only_this == 2
    assert lines["base", "short"].n_kept == 2 and lines["base", "short"].n_kept_without == 4
    assert lines["prose", "shouting"].n_only_this == 1 and lines["prose", "shouting"].n_kept_without == 2


def test_clashing_columns_and_empty_table(frame):
    docs = frame("n_words string, doc_id long, failed long, _text string, text string", [("x", 1, 7, "y", "a b")])
    assert ql.ledger(docs).collect()[0].n_words == 2
    flagged = ql.with_failed(docs, "bits").collect()[0]
    assert flagged.n_words == "x" and flagged.failed == 7 and flagged.bits & 3 == 1
    assert ql.ledger(docs.limit(0)).count() == 0
