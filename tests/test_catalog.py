"""Every query against its independent SQL, and shape rules of the plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from cohortweave.operators import joins, severity, stacking
from cohortweave.operators.cohort import PERSON_COLUMNS
from cohortweave.plans.build import CohortBuild
from cohortweave.plans.catalog import all_queries
from cohortweave.plans.oracle import all_oracles
from cohortweave.session import materialize
from cohortweave.settings import STANDIN_SETTINGS
from cohortweave.sources import standin
from cohortweave.sources.standin import standin_tables

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# their columns are the labels kept at one scale factor
LABEL_COLUMNS = {
    "binary_pivot", "conditions_only", "cohort_features", "exclude_early_outcome",
    "model_matrix", "train_rows", "test_rows", "labelled_rows",
}
ROWS_ONLY = {"tuning_trials", "risk_scores", "feature_importance"}
QUERIES = all_queries()
ORACLE = all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_sql_or_is_a_model_step():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


def assert_scalable(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", plan)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - LABEL_COLUMNS))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert_scalable(df)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    expected = canonical(columns, found.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize(
    "name",
    ["condition_mapped", "icd_match", "enrich_concept_name", "events_since_index",
     "codeset_usage", "visits_not_severe", "visit_name_list", "covid_severity",
     "vaccine_pre_post", "drug_sums", "cci_count", "label_frequency"],
)
def test_query_equals_sql_when_nothing_is_broadcast(spark, duck, monkeypatch, name):
    """Tables too large for a broadcast and hot keys give the same results."""
    monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 5)
    test_query_equals_sql(spark, duck, name)


@pytest.fixture(scope="module")
def build(spark):
    return CohortBuild(standin_tables(spark, SMALL), STANDIN_SETTINGS)


def test_flagship(spark, build):
    cohort = entry_module.entry(spark)
    assert_scalable(cohort)
    assert cohort.columns[:7] == PERSON_COLUMNS and cohort.columns[-1] == "who_severity"
    persons = build.index.count()
    assert cohort.count() == cohort.select("person_id").distinct().count() == persons
    features = cohort.columns[7:]
    assert cohort.filter(" OR ".join(f"`{c}` IS NULL" for c in features)).count() == 0


def test_label_columns_hold_the_frequencies(build):
    wide = build.conditions_only
    sums = wide.selectExpr(*[f"sum(`{c}`) AS `{c}`" for c in build.kept_labels]).first().asDict()
    frequency = {r[0]: r[1] for r in build.label_frequency.collect()}
    assert sums == {label: frequency[label] for label in build.kept_labels}
    assert all(n < build.minimum_persons for label, n in frequency.items() if label not in sums)


@pytest.mark.parametrize("name", ["icd_match", "covid_severity", "medications_vaccinations"])
def test_result_does_not_depend_on_partitioning(spark, name):
    first = sorted(map(repr, QUERIES[name](spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(repr, QUERIES[name](spark, SMALL).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["medications_vaccinations"](spark, SMALL)
    text = plan._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert not read & {"l_tax", "l_discount", "l_quantity", "c_name", "o_orderpriority"}


@pytest.mark.parametrize("name", ["codeset_usage", "cohort_features", "no_visit_persons"])
def test_event_lines_are_derived_once(spark, monkeypatch, name):
    """All parts of the five event tables are filters of one written table."""
    written = []

    def noted(df, path_name):
        written.append(any("lineitem" in f for f in df.inputFiles()))
        return materialize(df, path_name)

    for module in (joins, severity, stacking, standin):
        monkeypatch.setattr(module, "materialize", noted, raising=False)
    result = QUERIES[name](spark, SMALL)
    assert sum(written) == 1 and not any("lineitem" in f for f in result.inputFiles())
