"""Demographics: one cleaned row per person with an index date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.demographics import (
    age_years,
    birth_date,
    ethnicity_group,
    gender_group,
    race_group,
)
from cohortweave.operators.stacking import stack_splits
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings
from cohortweave.sources.tables import Split

AGE = "age_at_covid"


def person_outcome(person: Split, outcome: Split) -> DataFrame:
    """Stacked persons with their outcome; persons without one are left out.

    Both sides are unique by person and already placed by it, so the join
    needs no further shuffle.
    """
    persons = stack_splits(person.train, person.test, "person_id")
    outcomes = stack_splits(outcome.train, outcome.test, "person_id")
    return persons.join(outcomes, "person_id")


def index_dates(person: Split, outcome: Split) -> DataFrame:
    """(person_id, covid_index) of the same persons, from two columns only."""
    narrow_person = Split(person.train.select("person_id"), person.test.select("person_id"))
    narrow_outcome = Split(
        outcome.train.select("person_id", "covid_index"),
        outcome.test.select("person_id", "covid_index"),
    )
    return person_outcome(narrow_person, narrow_outcome)


def age_at_index(
    persons: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS, use_flag: bool = True
) -> DataFrame:
    """Birth date and age at the index date.

    The 90-or-older flag is used when present; without the flag column the
    plain age is kept.
    """
    flag = None
    if use_flag and "is_age_90_or_older" in persons.columns:
        flag = F.col("is_age_90_or_older")
    born = persons.withColumn(
        "date_of_birth", birth_date(F.col("year_of_birth"), F.col("month_of_birth"))
    )
    return born.withColumn(
        AGE, age_years(F.col("covid_index"), F.col("date_of_birth"), flag, settings.age_cap)
    )


def impute_median(df: DataFrame, column: str, bounded: bool = True) -> DataFrame:
    """Add ``<column>_imputed``: nulls become the lower median of the column.

    The median is a scalar subquery: one value, no join and no driver step.
    ``bounded`` says the column has few distinct values (ages in whole years);
    the exact median then counts values map-side.  For other columns pass
    False to use a quantile sketch of fixed size (rank error 0.1 %).
    """
    if bounded:
        middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")
    else:
        middle = F.percentile_approx(column, 0.5, 1000)
    median = df.agg(middle.alias("median")).scalar()
    return df.withColumn(f"{column}_imputed", F.coalesce(F.col(column), median))


def group_race(persons: DataFrame) -> DataFrame:
    return persons.withColumn("race_cats", race_group(F.col("race_concept_name")))


def group_ethnicity(persons: DataFrame) -> DataFrame:
    return persons.withColumn("ethnicity_cats", ethnicity_group(F.col("ethnicity_concept_name")))


def group_gender(persons: DataFrame) -> DataFrame:
    return persons.withColumn("gender_cats", gender_group(F.col("gender_concept_name")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def clean_persons(persons: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS) -> DataFrame:
    """Age, imputed age and the three category groups."""
    aged = impute_median(age_at_index(persons, settings), AGE)
    return group_gender(group_ethnicity(group_race(aged)))


def person_all(
    person: Split, outcome: Split, settings: CohortSettings = DEFAULT_SETTINGS
) -> DataFrame:
    return clean_persons(person_outcome(person, outcome), settings)
