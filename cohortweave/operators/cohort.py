"""The cohort table and the model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME = "pasc_code_after_four_weeks"
PRIOR_OUTCOME = "pasc_code_prior_four_weeks"
# --- Fixed values: the columns of a person in the cohort ---
PERSON_COLUMNS = [
    "person_id",
    OUTCOME,
    PRIOR_OUTCOME,
    "age_at_covid_imputed",
    "gender_cats",
    "race_cats",
    "ethnicity_cats",
]
# --- end of fixed values ---


def assemble_cohort(
    persons: DataFrame, conditions: DataFrame, medications: DataFrame, severity: DataFrame
) -> DataFrame:
    """One row per person: demographics, conditions, drugs and severity.

    All four inputs are unique and placed by person, so the joins run where
    the rows already are.  Missing features are 0.
    """
    features = [c for df in (conditions, medications) for c in df.columns if c != "person_id"]
    merged = (
        persons.select(*PERSON_COLUMNS)
        .join(conditions, "person_id", "left")
        .join(medications, "person_id", "left")
        .join(severity, "person_id", "left")
    )
    return merged.fillna(0, subset=features)


def exclude_early_outcome(cohort: DataFrame) -> DataFrame:
    """Without persons whose outcome came too early; unlabelled rows stay."""
    return cohort.filter((F.col(PRIOR_OUTCOME) == 0) | F.col(OUTCOME).isNull())


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a category column.

    They name columns, hence the bound that Spark sets its own pivots.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more values than spark.sql.pivotMaxValues = {most}")
    return sorted(row[0] for row in found)


def dummy_encode(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = True,
    known: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace each category column by 0/1 columns, without the first value.

    ``known`` lists values that are already known and need no extra pass.  A
    missing category gives 0 everywhere.
    """
    encoded = []
    for column in columns:
        values = sorted((known or {}).get(column) or categories(df, column))
        for value in values[1 if drop_first else 0:]:
            present = F.coalesce(F.col(column) == value, F.lit(False)).cast("int")
            encoded.append(present.alias(f"{column}_{value}"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *encoded)


def model_matrix(
    cohort: DataFrame, known: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    kept = exclude_early_outcome(cohort).drop(PRIOR_OUTCOME, "race_cats", "ethnicity_cats")
    return dummy_encode(kept, ["who_severity", "gender_cats"], known=known)


def split_blinded(matrix: DataFrame, person_test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other persons, rows of the held-out persons)."""
    held_out = person_test.select("person_id")
    return (
        matrix.join(held_out, "person_id", "left_anti"),
        matrix.join(held_out, "person_id", "left_semi"),
    )


def labelled_rows(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.col(OUTCOME).isNotNull())
