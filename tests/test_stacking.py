from conftest import rows_of

from cohortweave.operators.stacking import stack_splits


def test_training_copy_wins_and_missing_columns_are_null(frame):
    train = frame("k int, a string, label int", [(1, "train", 1), (2, "train", 0)])
    test = frame("k int, a string", [(1, "test"), (3, "test"), (3, "test")])
    got = stack_splits(train, test, "k")
    assert got.columns == ["k", "a", "label"]
    assert rows_of(got) == [(1, "train", 1), (2, "train", 0), (3, "test", None)]


def test_choice_does_not_depend_on_row_order(frame, spark):
    rows = [(1, f"v{i}") for i in range(30)] + [(None, "x"), (None, "y")]
    empty = frame("k int, a string", [])
    first = stack_splits(frame("k int, a string", rows), empty, "k")
    second = stack_splits(frame("k int, a string", rows[::-1]).repartition(7), empty, "k")
    assert rows_of(first) == rows_of(second) == [(None, "x"), (1, "v0")]
