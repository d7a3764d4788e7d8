"""Comorbidity counts, and condition labels before and after the index date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.clinical import pre_or_post
from cohortweave.operators.eras import CATEGORY, best_mapping, with_category
from cohortweave.operators.joins import lookup_join, skew_join
from cohortweave.operators.stacking import stack_rows, stack_splits
from cohortweave.operators.vocabulary import codeset_members
from cohortweave.session import constant_rows, materialize
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings
from cohortweave.sources.tables import Split

LABEL = "pre_post_condition"
BITS = 62  # names per bigint mask


def comorbidity_count(
    matched: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Number of distinct comorbidity sets per person (none: no row)."""
    sets = (
        codeset_members(members, settings.comorbidity_codesets)
        .filter(F.col("concept_set_name").isNotNull())
        .select(F.col("concept_id").alias("condition_concept_id"), "concept_set_name")
        .distinct()
    )
    hits = lookup_join(
        matched,
        sets,
        "condition_concept_id",
        "inner",
        spread=["condition_era_id"],
        limit_bytes=limit_bytes,
    )
    return hits.groupBy("person_id").agg(F.countDistinct("concept_set_name").alias("cci_count"))


def pre_post_rows(
    matched: DataFrame, person_facts: DataFrame, *, hot: DataFrame | None = None
) -> DataFrame:
    """Matched eras with the facts of their person and the pre/post label."""
    joined = skew_join(
        matched, person_facts, "person_id", "left", spread=["condition_era_id"], hot=hot
    )
    facts = [c for c in person_facts.columns if c != "person_id"]
    timing = pre_or_post(F.col("condition_era_start_date"), F.col("covid_index"))
    return (
        joined.select(*matched.columns, *facts)
        .withColumn("pre_post_covid", timing)
        .withColumn(LABEL, F.concat("pre_post_covid", F.lit("_"), F.col(CATEGORY)))
    )


def cci_rows(
    matched: DataFrame,
    members: DataFrame,
    index: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Pre/post rows with the person's comorbidity count (none: 0).

    Index date and count are both one row per person, so they are merged first
    and the eras are joined to persons only once.
    """
    counts = comorbidity_count(matched, members, settings)
    person_facts = index.join(counts, "person_id", "full")
    return pre_post_rows(matched, person_facts, hot=hot).fillna(0, subset=["cci_count"])


def comorbidity_masks(
    members: DataFrame, settings: CohortSettings
) -> tuple[DataFrame, list[str]]:
    """Per concept, the set names it belongs to as bits of bigint columns.

    A codeset normally has one name, so one column serves; any number of names
    takes as many columns as it needs.  The names of the codesets in the
    settings are collected to number them.
    """
    sets = codeset_members(members, settings.comorbidity_codesets).filter(
        F.col("concept_set_name").isNotNull()
    )
    names = sorted(row[0] for row in sets.select("concept_set_name").distinct().collect())
    columns = [f"cci_mask_{i}" for i in range(-(-len(names) // BITS) or 1)]
    bit_of = constant_rows(
        sets.sparkSession,
        [(name, i // BITS, 1 << (i % BITS)) for i, name in enumerate(names)],
        "concept_set_name string, word int, bit bigint",
    )
    masks = (
        sets.join(F.broadcast(bit_of), "concept_set_name")
        .groupBy(F.col("concept_id").alias("condition_concept_id"))
        .agg(
            *[
                F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0)).alias(c)
                for i, c in enumerate(columns)
            ]
        )
    )
    return masks, columns


def condition_history(
    condition_era: Split,
    mapped: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    limit_bytes: int | None = None,
) -> DataFrame:
    """All that later steps need of the eras: one row per person and category.

    Holds the first and last start date, whether any era is undated, and the
    comorbidity bits.  A single scan and a single lookup feed it; rows combine
    map-side, so even a person with a third of all eras sends at most one row
    per category from each task.  Copies of an era are settled first, over four
    narrow columns; ``copies_agree`` in the settings saves that shuffle by era id.
    """
    masks, mask_columns = comorbidity_masks(members, settings)
    best = best_mapping(mapped, settings).drop("icd_length", "icd10cm_clean")
    # written: it is measured before it is looked up
    lookup = materialize(best.join(masks, "condition_concept_id", "left"), "concept-categories")
    narrow = ["person_id", "condition_concept_id", "condition_era_start_date"]
    if settings.copies_agree:
        parts = [part.select(*narrow) for part in (condition_era.train, condition_era.test)]
        eras = stack_rows(*parts)
    else:
        parts = [
            part.select("condition_era_id", *narrow)
            for part in (condition_era.train, condition_era.test)
        ]
        eras = stack_splits(*parts, key="condition_era_id").select(*narrow)
    day = F.col("condition_era_start_date")
    dated = eras.select(
        "person_id",
        "condition_concept_id",
        day.alias("first_start"),
        day.alias("last_start"),
        day.isNull().alias("undated"),
    )
    usable = with_category(
        dated,
        lookup,
        spread=["person_id"],
        key_rows=stack_rows(*[part.select("condition_concept_id") for part in parts]),
        combine=lambda rows: _merged_dates(rows, "person_id", "condition_concept_id"),
        limit_bytes=limit_bytes,
    )
    return _merged_dates(usable, "person_id", CATEGORY, masks=mask_columns)


def _merged_dates(rows: DataFrame, *keys: str, masks: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("first_start").alias("first_start"),
        F.max("last_start").alias("last_start"),
        F.max("undated").alias("undated"),
        *[F.coalesce(F.bit_or(c), F.lit(0)).alias(c) for c in masks],
    )


def history_labels(history: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (person, label), equal to those of the single eras.

    Some era is before the index date exactly when the first one is; some era
    is not exactly when the last one is not, or a date is unknown.
    """
    index_date = F.col("covid_index")
    before = F.col("first_start") < index_date
    after = index_date.isNull() | F.col("undated") | (F.col("last_start") >= index_date)

    def label(when: Column, prefix: str) -> Column:
        return F.when(when, F.concat(F.lit(prefix), F.col(CATEGORY)))

    labels = F.array(label(before, "pre_"), label(after, "post_"))
    return (
        history.select("person_id", CATEGORY, "first_start", "last_start", "undated")
        .join(index, "person_id", "left")
        .select("person_id", F.explode(labels).alias(LABEL))
        .filter(F.col(LABEL).isNotNull())
    )


def history_counts(history: DataFrame) -> DataFrame:
    """Comorbidity count of every person with a usable condition (none: 0)."""
    masks = [c for c in history.columns if c.startswith("cci_mask_")]
    merged = history.groupBy("person_id").agg(*[F.bit_or(c).alias(c) for c in masks])
    total = F.lit(0).cast("bigint")
    for c in masks:
        total = total + F.bit_count(c)
    return merged.select("person_id", total.alias("cci_count"))
