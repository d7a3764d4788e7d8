"""Medication and vaccine features from drug eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.joins import lookup_join, skew_join
from cohortweave.operators.stacking import stack_rows, stack_splits
from cohortweave.operators.vocabulary import codeset_members
from cohortweave.session import materialize
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings
from cohortweave.sources.tables import Split

PRE, POST = "pre_covid_vaccine", "post_covid_vaccine"


def flag_table(members: DataFrame, flags: dict[int, str]) -> DataFrame:
    """One row per concept of any listed codeset with a 0/1 column per flag."""
    return (
        codeset_members(members, list(flags))
        .groupBy(F.col("concept_id").alias("drug_concept_id"))
        .agg(
            *[
                F.max((F.col("codeset_id") == codeset).cast("int")).alias(name)
                for codeset, name in flags.items()
            ]
        )
    )


def codeset_flags(
    eras: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    key_rows: DataFrame | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """All flags in one lookup; an empty codeset or unknown concept gives 0."""
    flags = settings.drug_codesets
    joined = lookup_join(
        eras,
        flag_table(members, flags),
        "drug_concept_id",
        "left",
        spread=["drug_era_id"],
        key_rows=key_rows,
        limit_bytes=limit_bytes,
    )
    return joined.select(
        *eras.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in flags.values()]
    )


def drug_usage(flagged: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS) -> DataFrame:
    """Per flag: eras without it, eras with it and distinct persons with it.

    Eras shrink to one row per person first, so distinct persons become a
    plain count and one scan serves all flags.
    """
    names = list(settings.drug_codesets.values())
    per_person = flagged.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("_eras"), *[F.sum(n).alias(n) for n in names]
    )
    totals = per_person.agg(
        F.sum("_eras").alias("_eras"),
        *[F.sum(n).alias(f"{n}_eras") for n in names],
        *[
            F.count_if((F.col(n) > 0) & F.col("person_id").isNotNull()).alias(f"{n}_persons")
            for n in names
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("flag"),
                (F.col("_eras") - F.col(f"{n}_eras")).alias("eras_without"),
                F.col(f"{n}_eras").alias("eras_with"),
                F.col(f"{n}_persons").alias("persons_with"),
            )
            for n in names
        ]
    )
    return totals.select(F.inline(rows))


def with_index_split(flagged: DataFrame, settings: CohortSettings) -> DataFrame:
    """0/1 columns: vaccinated before, and on or after, the index date.

    An unknown index date gives neither.
    """
    given = F.col(settings.vaccine_flag) == 1
    day, index_date = F.col("drug_era_start_date"), F.col("covid_index")
    return flagged.withColumns(
        {
            PRE: F.when(given & (day < index_date), 1).otherwise(0),
            POST: F.when(given & (day >= index_date), 1).otherwise(0),
        }
    )


def vaccine_pre_post(
    flagged: DataFrame,
    index: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every flagged era with the index date and the two vaccine columns."""
    joined = skew_join(flagged, index, "person_id", "left", spread=["drug_era_id"], hot=hot)
    return with_index_split(joined.select(*flagged.columns, "covid_index"), settings)


def drug_sums(
    drug_era: Split,
    index: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Sums per person of every medication flag and the two vaccine columns.

    One scan.  Copies of an era are settled first, over four narrow columns.  If
    the settings say that they agree, only the few eras that carry a flag are made unique by era id, while
    all other eras of a person merge map-side into one row that only says the
    person is there.  Sums per person and vaccination day come next, so one
    person's rows are bounded by the calendar before they meet the index date.
    All aggregates are of fixed width and run as hash aggregates.
    """
    flags = list(settings.drug_codesets.values())
    meds = [n for n in flags if n != settings.vaccine_flag]
    narrow = ["drug_era_id", "person_id", "drug_concept_id", "drug_era_start_date"]
    parts = [part.select(*narrow) for part in (drug_era.train, drug_era.test)]
    if settings.copies_agree:
        eras = stack_rows(*parts)
    else:
        eras = stack_splits(*parts, key="drug_era_id")
    flagged = lookup_join(
        eras,
        # written: it is measured before it is looked up
        materialize(flag_table(members, settings.drug_codesets), "drug-flags"),
        "drug_concept_id",
        "left",
        spread=["drug_era_id"],
        key_rows=stack_rows(*[part.select("drug_concept_id") for part in parts]),
        combine=DataFrame.distinct,
        limit_bytes=limit_bytes,
    )
    # a concept of the flag table has at least one flag set
    marked = F.col(flags[0]).isNotNull()
    day = F.when(F.col(settings.vaccine_flag) == 1, F.col("drug_era_start_date"))
    if settings.copies_agree:
        unique = flagged.groupBy(
            "person_id", F.when(marked, F.col("drug_era_id")).alias("_era")
        ).agg(F.max(day).alias("_day"), *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in flags])
    else:
        unique = flagged.select(
            "person_id", day.alias("_day"), *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in flags]
        )
    by_day = unique.groupBy("person_id", "_day").agg(*[F.sum(n).alias(n) for n in flags])
    doses, index_date = F.col(settings.vaccine_flag), F.col("covid_index")
    dosed = by_day.join(index, "person_id", "left").withColumns(
        {
            PRE: F.when(F.col("_day") < index_date, doses).otherwise(0),
            POST: F.when(F.col("_day") >= index_date, doses).otherwise(0),
        }
    )
    return dosed.groupBy("person_id").agg(
        *[F.sum(n).alias(f"{n}_sum") for n in [*meds, PRE, POST]]
    )


def any_medication(
    sums: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS
) -> DataFrame:
    """One 0/1 ``med_sum`` in place of the single medication sums."""
    used = F.lit(False)
    for name in settings.drug_codesets.values():
        if name != settings.vaccine_flag:
            used = used | (F.col(f"{name}_sum") > 0)
    return sums.select(
        "person_id",
        f"{PRE}_sum",
        f"{POST}_sum",
        F.when(used, 1).otherwise(0).alias("med_sum"),
    )


def medications_vaccinations(
    drug_era: Split,
    index: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
) -> DataFrame:
    return any_medication(drug_sums(drug_era, index, members, settings), settings)
