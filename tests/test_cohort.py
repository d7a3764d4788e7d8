import pytest
from conftest import rows_of

from cohortweave.operators import cohort


@pytest.fixture
def assembled(frame):
    persons = frame(
        "person_id bigint, pasc_code_after_four_weeks int, pasc_code_prior_four_weeks int, "
        "age_at_covid_imputed double, gender_cats string, race_cats string, "
        "ethnicity_cats string, extra string",
        [
            (1, 1, 0, 50.0, "MALE", "White", None, "x"),
            (2, 0, 1, 60.0, "FEMALE", "Other", "E", "x"),
            (3, None, None, 70.0, None, "Unknown", "E", "x"),
        ],
    )
    conditions = frame(
        "person_id bigint, pre_A int, cci_count bigint", [(1, 1, 3), (2, None, 0)]
    )
    drugs = frame("person_id bigint, med_sum int", [(1, 1), (9, 1)])
    severity = frame(
        "person_id bigint, who_severity string", [(1, "Severe"), (2, "Mild"), (3, "Moderate")]
    )
    return cohort.assemble_cohort(persons, conditions, drugs, severity)


def test_one_row_per_person_and_zero_for_missing_features(assembled):
    assert assembled.columns == [
        *cohort.PERSON_COLUMNS, "pre_A", "cci_count", "med_sum", "who_severity"
    ]
    assert rows_of(assembled, "person_id", "pre_A", "cci_count", "med_sum", "who_severity") == [
        (1, 1, 3, 1, "Severe"), (2, 0, 0, 0, "Mild"), (3, 0, 0, 0, "Moderate")
    ]
    # only features are filled: labels of held-out persons stay unknown
    assert rows_of(assembled, "person_id", cohort.OUTCOME) == [(1, 1), (2, 0), (3, None)]


@pytest.mark.parametrize(
    "known", [None, {"who_severity": ["Severe", "Mild", "Moderate"], "gender_cats": ["MALE"]}]
)
def test_model_matrix(assembled, known):
    matrix = cohort.model_matrix(assembled, known=known)
    severities = [c for c in matrix.columns if c.startswith("who_severity")]
    genders = [c for c in matrix.columns if c.startswith("gender_cats")]
    if known:
        assert severities == ["who_severity_Moderate", "who_severity_Severe"]
        assert rows_of(matrix, "person_id", *severities) == [(1, 0, 1), (3, 1, 0)]
    else:
        assert severities == ["who_severity_Severe"]  # Mild left with person 2
    assert genders == []  # a single value is the dropped first one
    assert not {"race_cats", "ethnicity_cats", cohort.PRIOR_OUTCOME} & set(matrix.columns)


def test_missing_category_is_zero_everywhere(frame):
    df = frame("id int, g string", [(1, "a"), (2, "b"), (3, None)])
    encoded = cohort.dummy_encode(df, ["g"], drop_first=False)
    assert rows_of(encoded) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]


def test_split_and_labelled(assembled, frame):
    train, test = cohort.split_blinded(assembled, frame("person_id bigint", [(3,), (7,)]))
    assert rows_of(train, "person_id") == [(1,), (2,)]
    assert rows_of(test, "person_id") == [(3,)]
    assert rows_of(cohort.labelled_rows(assembled), "person_id") == [(1,), (2,)]
