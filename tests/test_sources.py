import datetime as dt
import os

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException

from cohortweave.__main__ import main
from cohortweave.operators.persons import age_at_index
from cohortweave.plans.build import CohortBuild
from cohortweave.settings import CohortSettings
from cohortweave.sources import schemas
from cohortweave.sources.tables import (
    add_concept_name,
    load_release,
    read_table,
    stored_or,
    write_table,
)

FILES = {
    "concept.csv": """concept_id,concept_name,domain_id,vocabulary_id,concept_class_id,concept_code,invalid_reason
5,flu,Condition,SNOMED,x,123,
101,flu code,Condition,ICD10CM,x,J10.1,
201,drug a,Drug,RxNorm,x,1,
301,Inpatient Visit,Visit,Visit,x,IP,
302,Outpatient Visit,Visit,Visit,x,OP,
401,White,Race,Race,x,1,
402,Not Hispanic or Latino,Ethnicity,Ethnicity,x,1,
403,FEMALE,Gender,Gender,x,F,
501,intubation,Procedure,x,x,1,
""",
    "concept_relationship.csv": "concept_id_1,concept_id_2,relationship_id\n101,5,Maps to\n",
    "DXCCSR_v2021.csv": "ICD-10-CM_CODE,description,Default_CCSR_CATEGORY_OP\n'J101',flu,'RSP002'\n",
    "concept_set_members.csv": (
        "codeset_id,concept_set_name,concept_id\n1,lung,5\n2,vent,501\n3,a,201\n"
    ),
    "training/condition_era.csv": (
        "person_id,condition_era_id,condition_concept_id,condition_era_start_date,"
        "condition_era_end_date,condition_occurrence_count\n"
        "1,1,5,2021-01-01,2021-01-02,1\n2,2,5,2021-06-01,2021-06-02,1\n"
    ),
    "testing/condition_era.csv": (
        "person_id,condition_era_id,condition_concept_id,condition_era_start_date,"
        "condition_era_end_date,condition_occurrence_count\n3,3,5,2020-06-01,2021-06-02,1\n"
    ),
    "training/drug_era.csv": (
        "drug_era_id,person_id,drug_concept_id,drug_era_start_date,drug_era_end_date,"
        "drug_exposure_count,gap_days\n1,1,201,2021-03-01,2021-03-02,1,0\n"
    ),
    "testing/drug_era.csv": (
        "drug_era_id,person_id,drug_concept_id,drug_era_start_date,drug_era_end_date,"
        "drug_exposure_count,gap_days\n2,3,999,2021-03-01,2021-03-02,1,0\n"
    ),
    "training/procedure_occurrence.csv": (
        "procedure_occurrence_id,person_id,procedure_concept_id,procedure_date,provider_id\n"
        "1,1,501,2021-03-05,7\n"
    ),
    "testing/procedure_occurrence.csv": (
        "procedure_occurrence_id,person_id,procedure_concept_id,procedure_date\n"
    ),
    "training/observation.csv": (
        "observation_id,person_id,observation_concept_id,observation_date\n"
    ),
    "testing/observation.csv": (
        "observation_id,person_id,observation_concept_id,observation_date\n"
    ),
    "training/condition_occurrence.csv": (
        "condition_occurrence_id,person_id,condition_concept_id,condition_start_date\n"
    ),
    "testing/condition_occurrence.csv": (
        "condition_occurrence_id,person_id,condition_concept_id,condition_start_date\n"
    ),
    "training/microvisits_to_macrovisits.csv": (
        "visit_occurrence_id,person_id,visit_concept_id,visit_start_date,visit_end_date,"
        "macrovisit_start_date,macrovisit_end_date\n1,2,301,2021-03-02,2021-03-03,,\n"
    ),
    "testing/microvisits_to_macrovisits.csv": (
        "visit_occurrence_id,person_id,visit_concept_id,visit_start_date,visit_end_date,"
        "macrovisit_start_date,macrovisit_end_date\n2,3,302,2021-03-02,2021-03-03,,\n"
    ),
    "training/person.csv": (
        "person_id,year_of_birth,month_of_birth,race_concept_id,ethnicity_concept_id,"
        "gender_concept_id\n1,1960,5,401,402,403\n2,,5,0,402,403\n"
    ),
    "testing/person.csv": (
        "person_id,year_of_birth,month_of_birth,race_concept_id,ethnicity_concept_id,"
        "gender_concept_id\n3,1980,5,401,402,403\n"
    ),
    "training/long_covid_silver_standard.csv": (
        "person_id,covid_index,pasc_code_after_four_weeks,pasc_code_prior_four_weeks\n"
        "1,2021-03-01,1,0\n2,2021-03-01,0,0\n"
    ),
    "testing/long_covid_silver_standard.csv": "person_id,covid_index\n3,2021-03-01\n",
}
SETTINGS = CohortSettings(
    comorbidity_codesets=(1,), ventilation_codeset=2, ecmo_codeset=4,
    drug_codesets={3: "med_a", 9: "covid_vaccine"}, rare_min_persons=2,
)


@pytest.fixture
def release(tmp_path):
    for name, text in FILES.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_csv_columns_follow_the_header(spark, release):
    eras = read_table(spark, f"{release}/training/condition_era.csv", schemas.CONDITION_ERA, "csv")
    assert eras.schema == schemas.CONDITION_ERA
    assert rows_of(eras, "condition_era_id", "person_id", "condition_era_start_date") == [
        (1, 1, dt.date(2021, 1, 1)), (2, 2, dt.date(2021, 6, 1))
    ]


def test_absent_optional_column_is_null(spark, release):
    persons = read_table(spark, f"{release}/training/person.csv", schemas.PERSON, "csv")
    assert rows_of(persons, "person_id", "is_age_90_or_older", "year_of_birth") == [
        (1, None, 1960), (2, None, None)
    ]
    # an unknown flag does not cap
    aged = age_at_index(persons.selectExpr("*", "DATE'2030-01-01' AS covid_index"))
    assert rows_of(aged, "age_at_covid") == [(None,), (70.0,)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_absent_required_column_fails(spark, tmp_path, fmt):
    path = str(tmp_path / "person")
    write_table(spark.range(3).selectExpr("id AS person_id", "2000 AS year_of_birth"), path, fmt)
    with pytest.raises(ValueError, match="month_of_birth, race_concept_id"):
        read_table(spark, path, schemas.PERSON, fmt)


def test_files_of_differing_headers_fail(spark, tmp_path):
    (tmp_path / "links").mkdir()
    (tmp_path / "links" / "a.csv").write_text("concept_id_1,concept_id_2,relationship_id\n1,2,Maps to\n")
    (tmp_path / "links" / "b.csv").write_text("concept_id_2,concept_id_1,relationship_id\n9,8,Maps to\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path / "links"), schemas.CONCEPT_RELATIONSHIP, "csv").collect()


def test_ready_names_are_read(spark, release):
    with open(f"{release}/training/person.csv", "w") as file:
        file.write(
            "person_id,year_of_birth,month_of_birth,race_concept_name,ethnicity_concept_id,"
            "gender_concept_name\n1,1960,5,Black,402,MALE\n"
        )
    with open(f"{release}/training/microvisits_to_macrovisits.csv", "w") as file:
        file.write(
            "visit_occurrence_id,person_id,visit_concept_name,visit_start_date,visit_end_date,"
            "macrovisit_start_date,macrovisit_end_date\n1,2,Inpatient Hospital,2021-03-02,2021-03-03,,\n"
        )
    tables = load_release(spark, release)
    assert rows_of(
        tables.person.train, "race_concept_name", "ethnicity_concept_name", "gender_concept_name"
    ) == [("Black", "Not Hispanic or Latino", "MALE")]
    assert rows_of(tables.visit.train, "visit_concept_name") == [("Inpatient Hospital",)]
    assert rows_of(tables.person.test, "race_concept_name") == [("White",)]


def test_malformed_value_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("person_id,covid_index\nabc,2021-01-01\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_table(spark, str(tmp_path / "bad.csv"), schemas.OUTCOME_TEST, "csv").collect()


def test_unknown_format_is_rejected(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x", schemas.OUTCOME_TEST, "xml")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_and_read_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, dt.date(2021, 1, 1)), (2, None)], schemas.OUTCOME_TEST)
    path = str(tmp_path / "out")
    write_table(df, path, fmt)
    assert rows_of(read_table(spark, path, schemas.OUTCOME_TEST, fmt)) == rows_of(df)
    with pytest.raises(PySparkException):
        write_table(df, path, fmt)  # never replaces by itself


def test_stored_mapping_is_used_when_present(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert stored_or(spark, str(tmp_path / "none"), lambda: df) is df
    assert stored_or(spark, None, lambda: df) is df
    write_table(df.selectExpr("a + 1 AS a"), str(tmp_path / "some"))
    assert rows_of(stored_or(spark, str(tmp_path / "some"), lambda: df)) == [(2,)]


@pytest.mark.parametrize("limit", [0, 150, 1 << 20])
def test_concept_names(frame, limit):
    concept = frame(
        "concept_id bigint, concept_name string", [(i, f"name {i}") for i in range(20)]
    )
    df = frame("id int, c bigint", [(1, 3), (2, 99), (3, None), (4, 3)])
    got = add_concept_name(df, concept, "c", "label", spread=["id"], limit_bytes=limit)
    assert rows_of(got) == [(1, 3, "name 3"), (2, 99, None), (3, None, None), (4, 3, "name 3")]


@pytest.mark.parametrize("event_names", [True, False])
def test_release_to_cohort(spark, release, event_names):
    tables = load_release(spark, release, event_names=event_names)
    assert rows_of(tables.visit.train, "visit_concept_name") == [("Inpatient Visit",)]
    if event_names:
        assert rows_of(tables.condition_era.test, "condition_concept_name") == [("flu",)]
    build = CohortBuild(tables, SETTINGS)
    assert rows_of(build.icd_match, "person_id", "icd10cm_clean", "condition_concept_name") == [
        (1, "J101", "flu"), (2, "J101", "flu"), (3, "J101", "flu")
    ]
    cohort = build.cohort
    assert "pre_RSP002" in cohort.columns and "post_RSP002" not in cohort.columns
    assert rows_of(
        cohort, "person_id", "age_at_covid_imputed", "race_cats", "pre_RSP002", "cci_count",
        "med_sum", "who_severity",
    ) == [
        (1, 61.0, "White", 1, 1, 1, "Severe"),
        (2, 41.0, "Unknown", 0, 1, 0, "Moderate"),
        (3, 41.0, "White", 1, 1, 0, "Mild"),
    ]


def test_unknown_table_is_an_attribute_error(spark, release):
    with pytest.raises(AttributeError):
        load_release(spark, release).nothing


def test_command_writes_the_chosen_steps(spark, release, tmp_path):
    out = str(tmp_path / "out")
    steps = ["icd_match", "covid_severity", "cohort", "model_matrix"]
    main([release, out, "--features-only", "--steps", *steps])
    assert sorted(os.listdir(out)) == sorted(steps)
    cohort = spark.read.parquet(f"{out}/cohort")
    # default codesets are unknown to this release
    assert rows_of(cohort, "person_id", "who_severity") == [(1, "Mild"), (2, "Moderate"), (3, "Mild")]


def test_csv_round_trip_keeps_values(spark, frame, tmp_path):
    ddl = "id bigint, name string, day date, price double"
    rows = [
        (1, 'with "quotes", commas', dt.date(2020, 2, 29), 0.1),
        (2, "", None, -1e300),
        (3, None, dt.date(1900, 1, 1), None),
        (None, "  spaces ", None, float("inf")),
    ]
    path = str(tmp_path / "copy.csv")
    write_table(frame(ddl, rows), path, "csv")
    back = read_table(spark, path, schemas.schema_of(ddl), "csv")
    # spaces around a value stay; CSV has no empty text beside null
    wanted = [tuple(None if v == "" else v for v in row) for row in rows]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, wanted))
    write_table(frame("id string, name string, day string, price string", [("x", "a", "b", "c")]), path, "csv", "append")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, path, schemas.schema_of(ddl), "csv").collect()
