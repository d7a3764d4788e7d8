"""Declared columns of every input table (health records, common data model)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}


def schema_of(text: str) -> T.StructType:
    """Schema from "name type, name type, ..."; needs no running session."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CONCEPT = schema_of(
    "concept_id bigint, concept_name string, concept_code string, domain_id string, "
    "vocabulary_id string, invalid_reason string"
)
CONCEPT_RELATIONSHIP = schema_of(
    "concept_id_1 bigint, concept_id_2 bigint, relationship_id string"
)
GROUPER = schema_of("ICD-10-CM_CODE string, Default_CCSR_CATEGORY_OP string")
CONCEPT_SET_MEMBERS = schema_of("codeset_id bigint, concept_set_name string, concept_id bigint")
CONDITION_ERA = schema_of(
    "condition_era_id bigint, person_id bigint, condition_concept_id bigint, "
    "condition_era_start_date date, condition_era_end_date date, "
    "condition_occurrence_count int"
)
DRUG_ERA = schema_of(
    "drug_era_id bigint, person_id bigint, drug_concept_id bigint, "
    "drug_era_start_date date, drug_era_end_date date, drug_exposure_count int, gap_days int"
)
PROCEDURE_OCCURRENCE = schema_of(
    "procedure_occurrence_id bigint, person_id bigint, procedure_concept_id bigint, "
    "procedure_date date"
)
OBSERVATION = schema_of(
    "observation_id bigint, person_id bigint, observation_concept_id bigint, "
    "observation_date date"
)
CONDITION_OCCURRENCE = schema_of(
    "condition_occurrence_id bigint, person_id bigint, condition_concept_id bigint, "
    "condition_start_date date"
)
VISIT = schema_of(
    "visit_occurrence_id bigint, person_id bigint, visit_concept_id bigint, "
    "visit_start_date date, visit_end_date date, macrovisit_start_date date, "
    "macrovisit_end_date date"
)
PERSON = schema_of(
    "person_id bigint, year_of_birth int, month_of_birth int, is_age_90_or_older boolean, "
    "race_concept_id bigint, ethnicity_concept_id bigint, gender_concept_id bigint"
)
OUTCOME_TRAIN = schema_of(
    "person_id bigint, covid_index date, pasc_code_after_four_weeks int, "
    "pasc_code_prior_four_weeks int"
)
OUTCOME_TEST = schema_of("person_id bigint, covid_index date")


#: Columns that a file may lack, and then are null: the flag is newer than some releases, the
#: blinded part has no outcome.  Any other absent column fails the read.
OPTIONAL = {
    "is_age_90_or_older", "pasc_code_after_four_weeks", "pasc_code_prior_four_weeks",
}


@dataclass(frozen=True)
class EventColumns:
    """Where an event table keeps its id, concept and date."""

    name: str
    id: str
    concept: str
    date: str


PROCEDURES = EventColumns(
    "procedure", "procedure_occurrence_id", "procedure_concept_id", "procedure_date"
)
OBSERVATIONS = EventColumns(
    "observation", "observation_id", "observation_concept_id", "observation_date"
)
CONDITIONS = EventColumns(
    "condition", "condition_occurrence_id", "condition_concept_id", "condition_start_date"
)
