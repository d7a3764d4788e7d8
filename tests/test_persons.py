import datetime as dt

from conftest import rows_of
from pyspark.sql import functions as F

from cohortweave.functions.demographics import ethnicity_group, gender_group, race_group
from cohortweave.operators import persons
from cohortweave.sources.tables import Split

D = dt.date


def test_age_edges(frame):
    rows = [
        (1, 1960, 1, False, D(2021, 1, 1)),
        (2, 1925, 6, True, D(2021, 1, 1)),      # flagged: capped
        (3, None, 6, False, D(2021, 1, 1)),
        (4, 1960, 13, False, D(2021, 1, 1)),    # no such month
        (5, 1960, 1, None, D(2021, 1, 1)),
        (6, 1960, 1, False, None),
    ]
    df = frame(
        "person_id int, year_of_birth int, month_of_birth int, is_age_90_or_older boolean, "
        "covid_index date", rows,
    )
    assert rows_of(persons.age_at_index(df), "person_id", "age_at_covid") == [
        (1, 61.0), (2, 90.0), (3, None), (4, None), (5, 61.0), (6, None)
    ]
    plain = persons.age_at_index(df.drop("is_age_90_or_older"))
    assert rows_of(plain.filter("person_id = 2"), "age_at_covid") == [(96.0,)]


def test_median_is_the_lower_middle_value(frame):
    df = frame("a double", [(1.0,), (2.0,), (3.0,), (4.0,), (None,)])
    for bounded in (True, False):
        got = persons.impute_median(df, "a", bounded)
        assert rows_of(got) == [(None, 2.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]


def test_groups(frame):
    df = frame("v string", [(None,), ("White Other",), ("Asian",), ("Asian Indian",), ("Black",)])
    race = df.select("v", race_group(F.col("v")).alias("g"))
    assert rows_of(race) == [
        (None, "Unknown"), ("Asian", "Asian_or_Pacific_islander"), ("Asian Indian", "Other"),
        ("Black", "African_American"), ("White Other", "White_Other"),
    ]
    df = frame("v string", [(None,), ("Unknown",), ("Hispanic or Latino",)])
    assert rows_of(df.select("v", ethnicity_group(F.col("v")))) == [
        (None, None), ("Hispanic or Latino", "Hispanic_or_Latino"), ("Unknown", "Other_unknown"),
    ]
    df = frame("v string", [(None,), ("UNKNOWN",), ("FEMALE",), ("No matching concept",)])
    assert rows_of(df.select("v", gender_group(F.col("v")))) == [
        (None, None), ("FEMALE", "FEMALE"), ("No matching concept", "MALE"), ("UNKNOWN", "MALE"),
    ]


def test_only_persons_with_an_outcome(frame):
    person = Split(frame("person_id int", [(1,), (2,)]), frame("person_id int", [(2,), (3,)]))
    outcome = Split(
        frame("person_id int, covid_index date, pasc int", [(1, D(2021, 1, 1), 1)]),
        frame("person_id int, covid_index date", [(3, D(2021, 1, 2)), (4, D(2021, 1, 3))]),
    )
    assert rows_of(persons.person_outcome(person, outcome)) == [
        (1, D(2021, 1, 1), 1), (3, D(2021, 1, 2), None)
    ]
    assert rows_of(persons.index_dates(person, outcome)) == [
        (1, D(2021, 1, 1)), (3, D(2021, 1, 2))
    ]


def test_value_counts(frame):
    df = frame("v string", [("a",), ("a",), (None,)])
    assert rows_of(persons.value_counts(df, "v")) == [(None, 1), ("a", 2)]
