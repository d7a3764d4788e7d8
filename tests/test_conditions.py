import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import rows_of

from cohortweave.operators import comorbidity, eras, labels, vocabulary
from cohortweave.operators.stacking import stack_splits
from cohortweave.settings import CohortSettings
from cohortweave.sources.tables import Split

SETTINGS = CohortSettings(
    comorbidity_codesets=(1, 2, 3), category_by_concept={7: "MBD005", 8: "SYM013"}
)
CAT = eras.CATEGORY


@pytest.fixture
def vocabulary_tables(frame):
    relationship = frame(
        "concept_id_1 bigint, concept_id_2 bigint, relationship_id string",
        [
            (101, 5, "Maps to"), (102, 5, "Maps to"), (103, 6, "Maps to"), (104, 7, "Maps to"),
            (105, 9, "Maps to"), (106, 10, "Maps to"), (107, 10, "Maps to"),
            (101, 101, "Maps to"), (101, 6, "Mapped from"), (108, 11, "Maps to"),
        ],
    )
    concept = frame(
        "concept_id bigint, concept_name string, concept_code string, domain_id string, "
        "vocabulary_id string, invalid_reason string",
        [
            (101, "a", "A01.1", "Condition", "ICD10CM", None),
            (102, "b", "A02", "Condition", "ICD10CM", None),
            (103, "c", "O10", "Condition", "ICD10CM", None),
            (104, "d", "X99", "Condition", "ICD10CM", None),   # no category
            (105, "e", "B01", "Condition", "ICD10CM", None),   # unusable category
            (106, "f", "C01", "Condition", "ICD10CM", None),
            (107, "g", "C02", "Condition", "ICD10CM", None),   # ties with C01
            (108, "h", "A02", "Drug", "ICD10CM", None),
            (109, "i", "A02", "Condition", "ICD10CM", "D"),
        ],
    )
    grouper = frame(
        "`ICD-10-CM_CODE` string, Default_CCSR_CATEGORY_OP string",
        [
            ("'A011'", "'INF001'"), ("'A02'", "'INF002'"), ("'O10'", "'PRG005'"),
            ("'B01'", "'XXX111'"), ("'C01'", "'NEO001'"), ("'C02'", "'NEO000'"),
            ("'Z99'", "'FAC001'"),
        ],
    )
    return relationship, concept, grouper


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_mapped_concepts_is_a_full_outer_join(vocabulary_tables, limit):
    got = vocabulary.mapped_concepts(*vocabulary_tables, limit_bytes=limit)
    assert rows_of(got, "concept_id_2", "concept_code_clean", "icd10cm_clean", CAT) == [
        (None, None, "Z99", "FAC001"),
        (5, "A011", "A011", "INF001"),
        (5, "A02", "A02", "INF002"),
        (6, "O10", "O10", "PRG005"),
        (7, "X99", None, None),
        (9, "B01", "B01", "XXX111"),
        (10, "C01", "C01", "NEO001"),
        (10, "C02", "C02", "NEO000"),
    ]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_icd_match(vocabulary_tables, frame, limit):
    mapped = vocabulary.mapped_concepts(*vocabulary_tables)
    day = dt.date(2021, 1, 1)
    concepts = [5, 6, 7, 8, 9, 10, 99, None]
    rows = frame(
        "condition_era_id bigint, person_id bigint, condition_concept_id bigint, "
        "condition_era_start_date date",
        [(i, 1, c, day) for i, c in enumerate(concepts)],
    )
    got = eras.icd_match(rows, mapped, SETTINGS, limit_bytes=limit)
    assert rows_of(got, "condition_concept_id", "icd10cm_clean", CAT, "icd_length") == [
        (5, "A02", "INF002", 3),        # shorter code wins
        (6, "O10", "PRG", 3),           # prefix recode
        (7, None, "MBD005", None),      # manual recode, mapping without category
        (8, None, "SYM013", None),      # manual recode, no mapping at all
        (10, "C01", "NEO001", 3),       # tie: smaller code
    ]


def test_best_mapping_equals_window_over_the_fan_out(vocabulary_tables, frame):
    """The per-concept choice gives the rows the per-era choice would give."""
    mapped = vocabulary.mapped_concepts(*vocabulary_tables)
    day = dt.date(2021, 1, 1)
    rows = frame(
        "condition_era_id bigint, person_id bigint, condition_concept_id bigint, "
        "condition_era_start_date date",
        [(i, i % 3, c, day) for i, c in enumerate([5, 6, 7, 8, 9, 10, 99] * 3)],
    )
    fanned = eras.drop_unusable(
        eras.recode_categories(vocabulary.map_conditions(rows, mapped), SETTINGS), SETTINGS
    )
    by_era = {}
    for r in eras.distinct_era_categories(fanned).collect():
        key = (r["icd_length"] is not None, r["icd_length"] or 0, r["icd10cm_clean"] or "", r[CAT])
        by_era[r["condition_era_id"]] = min(by_era.get(r["condition_era_id"], key), key)
    expected = sorted((era, k[2] or None, k[3]) for era, k in by_era.items())
    got = eras.icd_match(rows, mapped, SETTINGS)
    assert rows_of(got, "condition_era_id", "icd10cm_clean", CAT) == expected


def _random_release(frame, seed, n_names=4):
    draw = random.Random(seed)
    first = dt.date(2021, 1, 1)
    concepts = [5, 6, 7, 8, 9, 10, 99]
    records = [
        (
            i,
            1 if draw.random() < 0.4 else draw.randint(2, 9),  # one hot person
            draw.choice(concepts),
            None if draw.random() < 0.1 else first + dt.timedelta(draw.randint(0, 40)),
        )
        for i in range(120)
    ]
    schema = (
        "condition_era_id bigint, person_id bigint, condition_concept_id bigint, "
        "condition_era_start_date date"
    )
    split = Split(frame(schema, records[:80]), frame(schema, records[60:]))  # overlap: copies
    members = frame(
        "codeset_id bigint, concept_set_name string, concept_id bigint",
        [(1 + i % 3, f"set{i}", concepts[i % len(concepts)]) for i in range(n_names)]
        + [(1, None, 5), (44, "other", 5), (2, "set0", 6)],
    )
    index = frame(
        "person_id bigint, covid_index date",
        [(p, None if p == 4 else first + dt.timedelta(20)) for p in range(1, 8)],
    )
    return split, members, index


@pytest.mark.parametrize(
    "seed, n_names, limit",
    [(1, 4, 1 << 20), (2, 4, 0), (3, 150, 1 << 20), (4, 700, 1 << 20)],
)
def test_history_gives_labels_and_counts_of_single_eras(
    vocabulary_tables, frame, seed, n_names, limit
):
    split, members, index = _random_release(frame, seed, n_names)
    mapped = vocabulary.mapped_concepts(*vocabulary_tables)
    matched = eras.icd_match(
        stack_splits(split.train, split.test, "condition_era_id"), mapped, SETTINGS
    )
    rows = comorbidity.cci_rows(matched, members, index, SETTINGS)
    history = comorbidity.condition_history(split, mapped, members, SETTINGS, limit_bytes=limit)
    assert rows_of(comorbidity.history_labels(history, index)) == rows_of(
        rows.select("person_id", comorbidity.LABEL).distinct()
    )
    counts = comorbidity.history_counts(history)
    assert rows_of(counts) == rows_of(
        rows.select("person_id", "cci_count").distinct()
    )


def test_unknown_index_date_means_post(frame, vocabulary_tables):
    split, members, index = _random_release(frame, 5)
    mapped = vocabulary.mapped_concepts(*vocabulary_tables)
    history = comorbidity.condition_history(split, mapped, members, SETTINGS)
    found = comorbidity.history_labels(history, index)
    unknown = found.filter("person_id IN (4, 8, 9)")  # null date; not in the person table
    assert unknown.count() > 0
    assert unknown.filter("pre_post_condition LIKE 'pre_%'").count() == 0


@pytest.fixture
def label_rows(frame):
    return frame(
        "person_id bigint, pre_post_condition string",
        [(1, "pre_A"), (1, "pre_A"), (1, "post_B"), (2, "pre_A"), (3, "post_C"), (4, "pre_A")],
    )


def test_frequency_equals_column_sums(label_rows):
    frequency = labels.label_frequency(label_rows)
    assert rows_of(frequency) == [("post_B", 1), ("post_C", 1), ("pre_A", 3)]
    names = labels.label_list(frequency)
    assert rows_of(labels.label_frequency_unpivot(label_rows, names)) == rows_of(frequency)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_rare_labels_go_but_their_persons_stay(label_rows, frame, limit):
    frequency = labels.label_frequency(label_rows)
    kept_rows = labels.drop_rare_labels(
        label_rows, frequency, 2, spread=["person_id"], limit_bytes=limit
    )
    assert rows_of(kept_rows.distinct()) == [(1, "pre_A"), (2, "pre_A"), (4, "pre_A")]
    counts = frame("person_id bigint, cci_count bigint", [(1, 2), (2, 0), (3, 1), (4, 0)])
    wide = labels.conditions_only(label_rows, counts, labels.label_list(frequency, 2))
    assert wide.columns == ["person_id", "pre_A", "cci_count"]
    assert rows_of(wide) == [(1, 1, 2), (2, 1, 0), (3, None, 1), (4, 1, 0)]


def test_pivot_is_binary_and_filled(label_rows):
    wide = labels.binary_pivot(label_rows, ["post_B", "pre_A"])
    assert rows_of(wide) == [(1, 1, 1), (2, 0, 1), (3, 0, 0), (4, 0, 1)]


def test_threshold(frame):
    population = frame("person_id int", [(i,) for i in range(25)])
    assert labels.minimum_persons(population, CohortSettings()) == 1000
    assert labels.minimum_persons(population, replace(SETTINGS, rare_fraction=0.1)) == 3


def test_too_many_labels_is_an_error(spark, frame):
    frequency = frame("condition string, condition_count bigint", [(c, 5) for c in "abc"])
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="pivotMaxValues"):
            labels.label_list(frequency)
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)
