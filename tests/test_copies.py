"""Copies of a record that differ between the two parts: fused steps equal row-level ones."""

import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from cohortweave.operators import medications, severity
from cohortweave.operators.stacking import stack_splits, stacked_hits
from cohortweave.settings import CohortSettings
from cohortweave.sources.tables import Split

DAY = dt.date(2020, 6, 1)
SETTINGS = CohortSettings(drug_codesets={3: "med_a", 9: "covid_vaccine"}, ventilation_codeset=2, ecmo_codeset=4)


@pytest.fixture
def members(frame):
    rows = [(2, "vent", 501), (3, "a", 201), (9, "v", 202)]
    return frame("codeset_id bigint, concept_set_name string, concept_id bigint", rows)


@pytest.fixture
def index(frame):
    return frame("person_id bigint, covid_index date", [(p, DAY) for p in range(1, 6)])


def test_drug_copies(frame, members, index):
    schema = "drug_era_id bigint, person_id bigint, drug_concept_id bigint, drug_era_start_date date"
    train = [(1, 1, 201, DAY), (2, 3, 7, DAY), (3, 4, 202, DAY)]
    test = [(1, 2, 201, DAY), (2, 3, 201, DAY), (3, 4, 202, dt.date(2020, 1, 1)), (4, 5, 202, DAY)]
    split = Split(frame(schema, train), frame(schema, test))
    sums = medications.drug_sums(split, index, members, SETTINGS)
    assert rows_of(sums, "person_id", "med_a_sum", "pre_covid_vaccine_sum", "post_covid_vaccine_sum") == [
        (1, 1, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1), (5, 0, 0, 1)
    ]


def test_severity_copies(frame, members, index):
    schema = "procedure_occurrence_id bigint, person_id bigint, procedure_concept_id bigint, procedure_date date"
    train = [(1, 1, 501, DAY), (2, 2, 8, DAY), (3, 3, 501, dt.date(2019, 1, 1))]
    test = [(1, 4, 501, DAY), (2, 2, 501, DAY), (3, 3, 501, DAY), (4, 5, 501, DAY)]
    from cohortweave.sources.schemas import PROCEDURES

    tables = [(PROCEDURES, Split(frame(schema, train), frame(schema, test)))]
    fused = severity.severe_persons(tables, [], index, members, SETTINGS)
    assert rows_of(fused, "person_id") == [(1,), (5,)]
    rows = severity.codeset_events(tables, index, members, 2, SETTINGS)
    assert rows_of(rows.select("person_id").distinct()) == [(1,), (5,)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_stacked_hits_equal_hits_of_the_stack(frame, limit):
    schema = "id bigint, v bigint, w string"
    train = [(i, i % 5, "t") for i in range(40)] + [(7, 0, "a")]
    test = [(i, (i + 1) % 5, "u") for i in range(20, 60)] + [(None, 0, "n")]
    parts = [frame(schema, train), frame(schema, test)]

    def hits(df):
        return df.filter(F.col("v") == 0)

    got = stacked_hits(*parts, "id", hits, limit_bytes=limit)
    wanted = hits(stack_splits(*parts, "id")).filter("id IS NOT NULL")
    assert rows_of(got.filter("id IS NOT NULL"), "id", "v", "w") == rows_of(wanted, "id", "v", "w")
