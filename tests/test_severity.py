import datetime as dt
import random

import pytest
from conftest import rows_of

from cohortweave.operators import severity
from cohortweave.operators.stacking import stack_splits
from cohortweave.settings import CohortSettings
from cohortweave.sources.schemas import CONDITIONS, OBSERVATIONS, PROCEDURES
from cohortweave.sources.tables import Split

SETTINGS = CohortSettings(ventilation_codeset=1, ecmo_codeset=2)
FIRST = dt.date(2021, 1, 1)
NAMES = [None, "Inpatient Visit", "Outpatient Visit", "inpatient", "Emergency Room Visit"]


def day(n):
    return None if n is None else FIRST + dt.timedelta(n)


@pytest.fixture(params=[1, 2, 3])
def release(request, frame):
    draw = random.Random(request.param)

    def maybe(n):
        return None if draw.random() < 0.1 else day(n)

    def person():
        return 1 if draw.random() < 0.3 else draw.randint(2, 14)  # person 1 is hot

    def events(columns):
        rows = [
            (i, person(), draw.choice([10, 11, 20, 30, None]), maybe(draw.randint(0, 40)))
            for i in range(25)
        ]
        schema = f"{columns.id} bigint, person_id bigint, {columns.concept} bigint, " \
                 f"{columns.date} date"
        return Split(frame(schema, rows[:18]), frame(schema, rows[12:])), rows

    visits = []
    for i in range(40):
        start, macro = draw.randint(0, 40), draw.random() < 0.4
        visits.append(
            (
                i, person(), maybe(start), maybe(start + draw.randint(0, 6)),
                maybe(start - 2) if macro else None, maybe(start + 15) if macro else None,
                draw.choice(NAMES),
            )
        )
    schema = (
        "visit_occurrence_id bigint, person_id bigint, visit_start_date date, "
        "visit_end_date date, macrovisit_start_date date, macrovisit_end_date date, "
        "visit_concept_name string"
    )
    index_rows = [(p, None if p == 5 else day(draw.randint(10, 40))) for p in range(1, 13)]
    procedures, p_rows = events(PROCEDURES)
    observations, o_rows = events(OBSERVATIONS)
    conditions, c_rows = events(CONDITIONS)
    return {
        "tables": [
            (PROCEDURES, procedures), (OBSERVATIONS, observations), (CONDITIONS, conditions)
        ],
        "rows": {"procedure": p_rows, "observation": o_rows, "condition": c_rows},
        "visit": Split(frame(schema, visits[:30]), frame(schema, visits[20:])),
        "visit_rows": visits,
        "index": frame("person_id bigint, covid_index date", index_rows),
        "index_rows": dict(index_rows),
        "members": frame(
            "codeset_id bigint, concept_set_name string, concept_id bigint",
            [(1, "vent", 10), (1, "vent", 11), (2, "ecmo", 20), (3, "other", 30)],
        ),
    }


def brute_hits(release, sources, concepts):
    index = release["index_rows"]
    return {
        (source, i, p)
        for source in sources
        for i, p, c, d in release["rows"][source]
        if c in concepts and index.get(p) and d and d >= index[p] - dt.timedelta(7)
    }


def brute_labels(release):
    index = release["index_rows"]
    vent = brute_hits(release, ["procedure", "observation", "condition"], {10, 11})
    ecmo = brute_hits(release, ["procedure", "observation"], {20})
    severe = {p for _, _, p in vent | ecmo}
    names = {}
    for _, p, vs, ve, ms, me, name in release["visit_rows"]:
        at = index.get(p)
        if at is None or p in severe:
            continue
        if (
            (vs and vs >= at - dt.timedelta(7))
            or (vs and ve and vs <= at <= ve)
            or (ms and me and ms <= at <= me)
        ):
            names.setdefault(p, []).append(name)
    visit = {
        p: "Moderate" if any(n and "Inpatient" in n for n in found) else "Mild"
        for p, found in names.items()
    }
    return severe, names, visit


def test_all_steps_match_brute_force(release):
    r = release
    severe, names, visit = brute_labels(r)
    vent = severity.codeset_events(r["tables"], r["index"], r["members"], 1, SETTINGS)
    assert rows_of(vent, "source", "event_id", "person_id") == sorted(
        brute_hits(r, ["procedure", "observation", "condition"], {10, 11})
    )
    got_severe = severity.severe_persons(
        r["tables"], r["tables"][:2], r["index"], r["members"], SETTINGS
    )
    assert rows_of(got_severe, "person_id") == sorted((p,) for p in severe)
    visits = stack_splits(r["visit"].train, r["visit"].test, "visit_occurrence_id")
    qualifying = severity.qualifying_visits(
        severity.exclude_persons(visits, got_severe), r["index"], SETTINGS
    )
    assert rows_of(severity.visit_severity(qualifying)) == sorted(visit.items())
    texts = severity.visit_name_text(severity.visit_name_list(qualifying))
    assert rows_of(texts, "person_id", "concat_visit_concept_name") == sorted(
        (p, ", ".join(sorted(n for n in found if n))) for p, found in names.items()
    )
    rest = severity.persons_without_label(
        r["index"], got_severe, severity.visit_severity(qualifying)
    )
    assert rows_of(rest) == sorted((p,) for p in set(r["index_rows"]) - severe - set(visit))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_severe_persons_without_broadcast(release, limit):
    got = severity.severe_persons(
        release["tables"], release["tables"][:2], release["index"], release["members"],
        SETTINGS, limit_bytes=limit,
    )
    assert rows_of(got, "person_id") == sorted((p,) for p in brute_labels(release)[0])


def test_fused_severity_equals_the_cascade(release):
    r = release
    severe, _, visit = brute_labels(r)
    got = severity.covid_severity(
        r["tables"], r["tables"][:2], r["visit"], r["index"], r["members"], SETTINGS
    )
    assert rows_of(got) == [
        (p, "Severe" if p in severe else visit.get(p, "Mild")) for p in sorted(r["index_rows"])
    ]


def test_usage_and_person_reports(release, frame):
    vent = severity.codeset_events(
        release["tables"], release["index"], release["members"], 1, SETTINGS
    ).cache()
    hits = brute_hits(release, ["procedure", "observation", "condition"], {10, 11})
    concept = frame("concept_id bigint, concept_name string", [(10, "same"), (11, "same")])
    usage = severity.codeset_usage(vent, concept)
    assert rows_of(usage) == sorted(
        (s, "same", sum(h[0] == s for h in hits)) for s in {h[0] for h in hits}
    )
    persons = {s: len({h[2] for h in hits if h[0] == s}) for s in {h[0] for h in hits}}
    persons["all"] = len({h[2] for h in hits})
    assert rows_of(severity.codeset_persons(vent)) == sorted(persons.items())


def test_name_lists_have_a_row_per_name(frame):
    visits = frame(
        "person_id bigint, visit_concept_name string",
        [(1, "A")] * 5 + [(1, "A B")] * 2 + [(1, None), (2, None)],
    )
    got = severity.visit_name_list(visits)
    assert rows_of(got) == [(1, "A", 5), (1, "A B", 2), (2, None, 1)]
    assert rows_of(severity.visit_name_text(got)) == [(1, "A, A, A, A, A, A B, A B"), (2, "")]


def test_long_name_lists_come_in_segments(frame):
    visits = frame(
        "person_id bigint, visit_concept_name string",
        [(1, "A")] * 5 + [(1, "A B")] * 2 + [(1, None)] * 9 + [(2, None)] * 9 + [(3, "")],
    )
    names = severity.visit_name_list(visits)
    assert rows_of(severity.visit_name_segments(names, 3)) == [
        (1, 0, "A, A, A"), (1, 1, "A, A, A B"), (1, 2, "A B"), (2, 0, ""), (3, 0, ""),
    ]
    whole = [(p, 0, text) for p, text in rows_of(severity.visit_name_text(names))]
    assert rows_of(severity.visit_name_segments(names)) == whole
    assert severity.visit_name_segments(names.limit(0)).count() == 0
    with pytest.raises(ValueError, match="segment"):
        severity.visit_name_segments(names, 0)
