"""One diagnosis category per condition era.

Which mapping wins depends only on the era's concept.  So the choice is made
once per concept on the vocabulary, and the eras, the largest table, are only
looked up: no row fan-out, no window and no shuffle over the eras.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.clinical import recoded_category, usable_category
from cohortweave.operators.joins import lookup_join
from cohortweave.session import constant_rows
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings

CATEGORY = "default_ccsr_category_op_clean"
ERA_COLUMNS = [
    "person_id",
    "condition_era_id",
    "condition_era_start_date",
    "icd10cm_clean",
    CATEGORY,
    "condition_concept_id",
    "condition_concept_name",
]


def recode_categories(
    conditions: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS
) -> DataFrame:
    return conditions.withColumn(
        CATEGORY, recoded_category(F.col(CATEGORY), F.col("condition_concept_id"), settings)
    )


def drop_unusable(conditions: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS) -> DataFrame:
    return conditions.filter(usable_category(F.col(CATEGORY), settings))


def distinct_era_categories(conditions: DataFrame) -> DataFrame:
    """The preferred row of every (era, category) pair.

    Input is the recoded, usable many-to-many mapping.  ``min`` over a struct
    combines map-side before rows move.
    """
    keep = [
        c
        for c in conditions.columns
        if c in ERA_COLUMNS and c not in ("condition_era_id", CATEGORY, "icd10cm_clean")
    ]
    best = conditions.groupBy("condition_era_id", CATEGORY).agg(
        F.min(F.struct(F.length("icd10cm_clean").alias("icd_length"), "icd10cm_clean", *keep))
        .alias("_best")
    )
    return best.select("condition_era_id", CATEGORY, "_best.*")


def best_mapping(
    mapped: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    concept: DataFrame | None = None,
) -> DataFrame:
    """The winning code and category of every concept that has a usable one.

    Shorter codes are broader and come first; a missing code precedes all.
    Structs compare field by field with nulls first, which makes this a total
    order over the mappings of a concept.  A manually recoded concept without
    any mapping counts too, with no code.  ``concept`` adds the names.
    """
    mappings = mapped.filter(F.col("concept_id_2").isNotNull()).select(
        F.col("concept_id_2").alias("condition_concept_id"),
        "icd10cm_clean",
        CATEGORY,
        F.lit(0).alias("_manual"),
    )
    if settings.category_by_concept:
        manual = constant_rows(
            mapped.sparkSession,
            [(c, None, None, 1) for c in settings.category_by_concept],
            f"condition_concept_id bigint, icd10cm_clean string, {CATEGORY} string, _manual int",
        )
        mappings = mappings.unionByName(manual)
    usable = drop_unusable(recode_categories(mappings, settings), settings)
    preference = F.struct(
        "_manual", F.length("icd10cm_clean").alias("icd_length"), "icd10cm_clean", CATEGORY
    )
    best = (
        usable.groupBy("condition_concept_id")
        .agg(F.min(preference).alias("_best"))
        .select("condition_concept_id", "_best.*")
        .drop("_manual")
    )
    if concept is None:
        return best
    names = concept.select(
        F.col("concept_id").alias("condition_concept_id"),
        F.col("concept_name").alias("condition_concept_name"),
    )
    return best.join(names, "condition_concept_id", "left")


def with_category(
    eras: DataFrame,
    best: DataFrame,
    *,
    key_rows: DataFrame | None = None,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    spread: Sequence[str] = ("condition_era_id",),
    limit_bytes: int | None = None,
) -> DataFrame:
    """Eras whose concept has a usable category, with that category."""
    return lookup_join(
        eras,
        best,
        "condition_concept_id",
        "inner",
        spread=spread,
        key_rows=key_rows,
        combine=combine,
        limit_bytes=limit_bytes,
    )


def icd_match(
    eras: DataFrame,
    mapped: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    concept: DataFrame | None = None,
    key_rows: DataFrame | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """One row per era that has a usable category (eras unique by id).

    Concept names come along with the lookup when ``concept`` is given and the
    eras do not hold them already.
    """
    if "condition_concept_name" in eras.columns:
        concept = None
    best = best_mapping(mapped, settings, concept)
    matched = with_category(eras, best, key_rows=key_rows, limit_bytes=limit_bytes)
    return matched.select(*[c for c in ERA_COLUMNS if c in matched.columns], "icd_length")
