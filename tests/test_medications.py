import datetime as dt
import random

import pytest
from conftest import rows_of

from cohortweave.operators import medications
from cohortweave.operators.stacking import stack_splits
from cohortweave.settings import CohortSettings
from cohortweave.sources.tables import Split

SETTINGS = CohortSettings(drug_codesets={1: "med_a", 2: "med_b", 3: "covid_vaccine"})
FIRST = dt.date(2021, 1, 1)


@pytest.fixture
def release(frame):
    draw = random.Random(4)
    records = [
        (
            i,
            1 if draw.random() < 0.4 else draw.randint(2, 9),
            draw.choice([10, 11, 30, 31, 40, 41, None]),
            None if draw.random() < 0.1 else FIRST + dt.timedelta(draw.randint(0, 20)),
        )
        for i in range(90)
    ]
    schema = (
        "drug_era_id bigint, person_id bigint, drug_concept_id bigint, drug_era_start_date date"
    )
    members = frame(
        "codeset_id bigint, concept_set_name string, concept_id bigint",
        [(1, "a", 10), (1, "a", 11), (3, "v", 30), (3, "v", 31), (1, "a", 31), (9, "x", 40)],
    )  # codeset 2 is empty, concept 31 is in two codesets
    index_rows = [(p, None if p == 3 else FIRST + dt.timedelta(10)) for p in range(1, 7)]
    return (
        Split(frame(schema, records[:60]), frame(schema, records[40:])),
        members,
        frame("person_id bigint, covid_index date", index_rows),
        records,
        dict(index_rows),
    )


def brute(records, index):
    sums = {}
    for _, p, c, d in records:
        s = sums.setdefault(p, [0, 0, 0, 0])
        s[0] += c in (10, 11, 31)
        vaccine, at = c in (30, 31), index.get(p)
        if vaccine and d and at:
            s[2 if d < at else 3] += 1
    return sums


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_sums_match_brute_force(release, limit):
    split, members, index, records, index_rows = release
    got = medications.drug_sums(split, index, members, SETTINGS, limit_bytes=limit)
    assert got.columns == [
        "person_id", "med_a_sum", "med_b_sum", "pre_covid_vaccine_sum", "post_covid_vaccine_sum"
    ]
    expected = brute(records, index_rows)
    assert rows_of(got) == sorted((p, *s) for p, s in expected.items())
    assert rows_of(medications.any_medication(got, SETTINGS)) == sorted(
        (p, s[2], s[3], int(s[0] + s[1] > 0)) for p, s in expected.items()
    )


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_row_level_flags_agree_with_the_sums(release, limit):
    split, members, index, records, index_rows = release
    eras = stack_splits(split.train, split.test, "drug_era_id")
    flagged = medications.codeset_flags(eras, members, SETTINGS, limit_bytes=limit)
    assert flagged.count() == len(records)
    rows = medications.vaccine_pre_post(flagged, index, SETTINGS)
    sums = {}
    for r in rows.collect():
        s = sums.setdefault(r["person_id"], [0, 0, 0, 0])
        values = (r["med_a"], r["med_b"], r["pre_covid_vaccine"], r["post_covid_vaccine"])
        for i, v in enumerate(values):
            s[i] += v
    assert sums == brute(records, index_rows)


def test_usage(release):
    split, members, _, records, _ = release
    eras = stack_splits(split.train, split.test, "drug_era_id")
    usage = medications.drug_usage(
        medications.codeset_flags(eras, members, SETTINGS), SETTINGS
    )
    expected = []
    for flag, concepts in (("med_a", (10, 11, 31)), ("med_b", ()), ("covid_vaccine", (30, 31))):
        hits = [r for r in records if r[2] in concepts]
        expected.append((flag, len(records) - len(hits), len(hits), len({r[1] for r in hits})))
    assert rows_of(usage) == sorted(expected)
