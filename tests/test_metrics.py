import hashlib
import random

import pytest
from conftest import rows_of

from cohortweave.operators import metrics


def test_split_takes_the_share_of_every_class(frame):
    people = [(i, int(i % 7 == 0)) for i in range(200)]
    got = metrics.stratified_split(frame("person_id bigint, y int", people), "y", fraction=0.2)
    expected = []
    for label in (0, 1):
        ids = sorted(
            (hashlib.md5(f"123:{i}".encode()).hexdigest(), i) for i, y in people if y == label
        )
        expected += [(i, label, rank * 5 < len(ids) // 5 * 5) for rank, (_, i) in enumerate(ids)]
    assert rows_of(got) == sorted(expected)


def test_split_ignores_partitioning(frame):
    df = frame("person_id bigint, y int", [(i, i % 2) for i in range(50)])
    one = metrics.stratified_split(df, "y", fraction=0.3)
    other = metrics.stratified_split(df.repartition(9), "y", fraction=0.3)
    assert rows_of(one) == rows_of(other)
    assert one.filter("is_holdout").count() == 14  # floor(7.5) of each class


def test_rows_without_label_or_key_are_kept(frame):
    df = frame("person_id bigint, y int", [(i, i % 2) for i in range(20)] + [(None, 1), (30, None), (None, None)])
    got = metrics.stratified_split(df, "y", fraction=0.5)
    assert got.count() == 23
    assert got.filter("(y IS NULL OR person_id IS NULL) AND is_holdout").count() == 0
    assert got.filter("is_holdout").count() == 10


def test_weights(frame):
    got = metrics.class_weight(frame("y int", [(0,), (1,)]), "y", 6)
    assert rows_of(got) == [(0, 1.0), (1, 6.0)]


def test_metrics(frame):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 3 + [(None, 1)]
    counts = metrics.confusion(frame("y int, g int", rows), "y", "g")
    assert rows_of(counts) == [(5, 2, 1, 3)]
    got = metrics.binary_metrics(counts).first()
    assert got["accuracy"] == pytest.approx(8 / 11)
    assert got["precision"] == pytest.approx(3 / 5)
    assert got["recall"] == pytest.approx(3 / 4)
    assert got["f1"] == pytest.approx(6 / 9)
    assert got["auc_hard"] == pytest.approx((3 / 4 + 5 / 7) / 2)


def test_metrics_without_denominator(frame):
    got = metrics.binary_metrics(
        metrics.confusion(frame("y int, g int", [(0, 0)]), "y", "g")
    ).first()
    assert tuple(got) == (1.0, 0.0, 0.0, 0.0, None)


@pytest.mark.parametrize("distinct", [3, 40, 2_000])
def test_rank_auc_matches_pair_counting(frame, distinct):
    draw = random.Random(distinct)
    rows = [(draw.randint(0, 1), draw.randint(1, distinct) ** 3 / 7) for _ in range(600)]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(2 * (p > n) + (p == n) for p in pos for n in neg)
    df = frame("y int, s double", [*rows, (None, 1.0), (1, None)])
    got = metrics.rank_auc(df, "y", "s", rows_per_range=37).first()
    assert got["auc"] == wins / (2 * len(pos) * len(neg))
    assert (got["positives"], got["negatives"]) == (len(pos), len(neg))


def test_rank_auc_of_one_class_is_unknown(frame):
    df = frame("y int, s double", [(1, 0.5), (1, 0.7)])
    assert metrics.rank_auc(df, "y", "s").first()["auc"] is None
