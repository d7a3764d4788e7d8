"""Stacking the training and the held-out part of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.joins import lookup_join
from cohortweave.session import materialize


def stack_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts by column name; a column absent from one part is null there.

    Copies of a record may remain, and may differ.
    """
    return train.unionByName(test, allowMissingColumns=True)


def stack_splits(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: the training copy if there is one.

    Further ties go to the smallest row, so the choice does not depend on the
    order in which tasks finish.  ``min`` over a struct combines map-side:
    however many copies one key has, each task sends a single one.
    """
    if train.columns == test.columns == [key]:
        return stack_rows(train, test).distinct()
    both = stack_rows(
        train.withColumn("_part", F.lit(0)), test.withColumn("_part", F.lit(1))
    )
    rest = [c for c in both.columns if c not in (key, "_part")]
    columns = [c for c in both.columns if c != "_part"]
    picked = both.groupBy(key).agg(
        F.min(F.struct("_part", *[F.col(f"`{c}`") for c in rest])).alias("_row")
    )
    return picked.select(
        *[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in columns]
    )


def stacked_hits(
    train: DataFrame,
    test: DataFrame,
    key: str,
    hits: Callable[[DataFrame], DataFrame],
    *,
    copies_agree: bool = False,
    limit_bytes: int | None = None,
) -> DataFrame:
    """``hits(stack_splits(train, test, key))`` where ``hits`` keeps few rows.

    Only the records of which some copy is a hit are made unique: their ids are
    collected from both parts, all copies of these ids are looked up, and
    the copy that wins must be a hit itself.  The tables are scanned twice but
    never shuffled, unless the ids are too many to broadcast.
    ``copies_agree`` says that copies of a record are equal and saves the
    second scan.  Rows without id are no records and drop out.
    """
    found = [hits(part) for part in (train, test)]
    if copies_agree:
        return stack_splits(*found, key=key)
    ids = materialize(stack_rows(*[part.select(key) for part in found]).distinct(), "hit-ids")
    copies = [
        lookup_join(part, ids, key, "left_semi", spread=part.columns, limit_bytes=limit_bytes)
        for part in (train, test)
    ]
    return hits(stack_splits(*copies, key=key))
