"""Vocabulary mapping: standard concepts to diagnosis codes and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.text import without_dots, without_quotes
from cohortweave.operators.joins import lookup_join


def codeset_members(members: DataFrame, codesets: Sequence[int]) -> DataFrame:
    """Members of the given codesets; the filter reaches the scan."""
    return members.filter(F.col("codeset_id").isin(*codesets))


def codeset_concepts(members: DataFrame, codesets: Sequence[int], id_col: str) -> DataFrame:
    """Distinct concept ids of some codesets under the name ``id_col``."""
    return codeset_members(members, codesets).select(F.col("concept_id").alias(id_col)).distinct()


def maps_to(relationship: DataFrame) -> DataFrame:
    """Links that map a concept to a different one."""
    return relationship.filter(
        (F.col("relationship_id") == "Maps to") & (F.col("concept_id_1") != F.col("concept_id_2"))
    )


def source_codes(
    concept: DataFrame, domain: str = "Condition", vocabulary: str = "ICD10CM"
) -> DataFrame:
    """Valid source concepts with their code freed of dots."""
    return concept.filter(
        (F.col("domain_id") == domain)
        & (F.col("vocabulary_id") == vocabulary)
        & F.col("invalid_reason").isNull()
    ).withColumn("concept_code_clean", without_dots(F.col("concept_code")))


def clean_grouper(grouper: DataFrame) -> DataFrame:
    """Code and category of the grouper table freed of single quotes."""
    return grouper.withColumns(
        {
            "icd10cm_clean": without_quotes(F.col("`ICD-10-CM_CODE`")),
            "default_ccsr_category_op_clean": without_quotes(F.col("Default_CCSR_CATEGORY_OP")),
        }
    )


def mapped_concepts(
    relationship: DataFrame,
    concept: DataFrame,
    grouper: DataFrame,
    *,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Full outer join of mapped source codes with the category grouper.

    Written as left join plus unmatched grouper rows: many concepts share one
    code, and this form lets the small grouper be broadcast, so the concept
    side is never shuffled by a code that may be hot.
    """
    links = maps_to(relationship).select("concept_id_1", "concept_id_2")
    codes = source_codes(concept).select(
        F.col("concept_id").alias("concept_id_1"), "concept_name", "concept_code_clean"
    )
    concept_map = lookup_join(
        links,
        codes,
        "concept_id_1",
        "inner",
        spread=["concept_id_1", "concept_id_2"],
        limit_bytes=limit_bytes,
    ).select(
        F.col("concept_id_1").alias("concept_id"),
        "concept_name",
        "concept_code_clean",
        "concept_id_1",
        "concept_id_2",
    )
    categories = clean_grouper(grouper)
    by_code = categories.withColumn("concept_code_clean", F.col("icd10cm_clean"))
    matched = lookup_join(
        concept_map,
        by_code,
        "concept_code_clean",
        "left",
        spread=["concept_id_1", "concept_id_2"],
        limit_bytes=limit_bytes,
    ).select(*concept_map.columns, *categories.columns)
    used_codes = concept_map.select(F.col("concept_code_clean").alias("icd10cm_clean")).distinct()
    unmatched = categories.join(used_codes, "icd10cm_clean", "left_anti").select(
        *categories.columns
    )
    return matched.unionByName(unmatched, allowMissingColumns=True)


def map_conditions(
    eras: DataFrame, mapped: DataFrame, *, limit_bytes: int | None = None
) -> DataFrame:
    """Every era with every mapping of its concept (left, many to many)."""
    by_concept = mapped.filter(F.col("concept_id_2").isNotNull()).withColumn(
        "condition_concept_id", F.col("concept_id_2")
    )
    joined = lookup_join(
        eras,
        by_concept,
        "condition_concept_id",
        "left",
        spread=["condition_era_id"],
        limit_bytes=limit_bytes,
    )
    return joined.select(*eras.columns, *mapped.columns)
