"""Label frequencies, rare labels and the binary person-by-label matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.comorbidity import LABEL
from cohortweave.operators.joins import lookup_join
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings


def label_frequency(rows: DataFrame, unique: bool = False) -> DataFrame:
    """Distinct persons per label.

    Pairs are made distinct first, so a frequent label is counted map-side;
    ``unique`` says that they are.
    """
    pairs = rows.select("person_id", LABEL)
    return (
        (pairs if unique else pairs.distinct())
        .groupBy(F.col(LABEL).alias("condition"))
        .agg(F.count("person_id").alias("condition_count"))
    )


def binary_pivot(
    rows: DataFrame, labels: Sequence[str], key: str = "person_id", label: str = LABEL
) -> DataFrame:
    """One row per key with an int column per label: 1 if present, else 0."""
    pairs = rows.select(key, label)
    return pairs.groupBy(key).pivot(label, list(labels)).agg(F.max(F.lit(1))).fillna(0)


def label_frequency_unpivot(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Label frequency by summing the columns of the matrix and unpivoting."""
    wide = binary_pivot(rows, labels)
    sums = wide.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in labels])
    return sums.unpivot([], list(labels), "condition", "condition_count")


def minimum_persons(population: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS) -> int:
    """Fewest persons a kept label needs."""
    if settings.rare_fraction is None:
        return settings.rare_min_persons
    return math.ceil(Fraction(str(settings.rare_fraction)) * population.count())


def drop_rare_labels(
    rows: DataFrame,
    frequency: DataFrame,
    min_persons: int,
    *,
    spread: Sequence[str],
    limit_bytes: int | None = None,
) -> DataFrame:
    """Rows whose label is not rare."""
    rare = frequency.filter(F.col("condition_count") < min_persons).select(
        F.col("condition").alias(LABEL)
    )
    return lookup_join(
        rows, rare, LABEL, "left_anti", spread=spread, limit_bytes=limit_bytes
    ).select(*rows.columns)


def kept_labels(frequency: DataFrame, min_persons: int) -> DataFrame:
    """Labels with at least ``min_persons`` persons and their number of persons."""
    return frequency.filter(F.col("condition_count") >= min_persons)


def label_list(frequency: DataFrame, min_persons: int = 0) -> list[str]:
    """Sorted labels with at least ``min_persons`` persons.

    These become column names, so they must reach the driver.  More than
    ``spark.sql.pivotMaxValues`` is an error, as in Spark's own pivot, never a
    silent cut; raise that setting or the threshold.
    """
    most = int(frequency.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = (
        kept_labels(frequency, min_persons)
        .select("condition")
        .limit(most + 1)
        .collect()
    )
    if len(found) > most:
        raise ValueError(f"more labels than spark.sql.pivotMaxValues = {most}")
    return sorted(row[0] for row in found)


def conditions_only(
    labels: DataFrame, counts: DataFrame, kept: Sequence[str]
) -> DataFrame:
    """Matrix of the kept labels for every person with a condition.

    A person with rare labels only stays, with null label columns, next to the
    comorbidity count.
    """
    wide = binary_pivot(labels.filter(F.col(LABEL).isin(*kept)), kept)
    return wide.join(counts, "person_id", "right")
