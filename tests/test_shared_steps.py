"""Steps that several parts of a query share are run once."""

import pytest
from conftest import rows_of

from cohortweave.operators import severity, stacking
from cohortweave.plans.build import CohortBuild
from cohortweave.plans.catalog import all_queries
from cohortweave.session import constant_rows, materialize
from cohortweave.settings import STANDIN_SETTINGS
from cohortweave.sources import standin
from cohortweave.sources.standin import standin_tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["codeset_persons", "no_visit_persons", "exclude_early_outcome"])
def test_event_tables_are_searched_once_for_both_codesets(spark, monkeypatch, name):
    written = []

    def noted(df, path_name):
        written.append((path_name, tuple(df.columns)))
        return materialize(df, path_name)

    for module in (severity, stacking):
        monkeypatch.setattr(module, "materialize", noted)
    all_queries()[name](spark, SMALL)
    of_events = [name for name, columns in written if columns != ("visit_occurrence_id",)]
    assert of_events == ["hit-ids", "codeset-events"]


def test_shared_hits_give_the_events_of_each_codeset(spark):
    build = CohortBuild(standin_tables(spark, SMALL), STANDIN_SETTINGS)
    members = build.tables.concept_set_members
    for tables, codeset in (
        (build.ventilation_tables, STANDIN_SETTINGS.ventilation_codeset),
        (build.ecmo_tables, STANDIN_SETTINGS.ecmo_codeset),
    ):
        alone = severity.codeset_events(tables, build.index, members, codeset, STANDIN_SETTINGS)
        shared = severity.codeset_events(
            tables, build.index, members, codeset, STANDIN_SETTINGS, hits=build.codeset_hits
        )
        assert rows_of(shared, *alone.columns) == rows_of(alone)


def test_event_lines_move_once(spark):
    """Order lines and orders are shuffled once each, by order."""
    given = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "orders")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = standin._event_lines(*given)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_constant_rows_start_no_python(spark):
    rows = constant_rows(spark, [("a", 1), (None, 2)], "`a-b` string, n bigint")
    assert rows_of(rows) == [(None, 2), ("a", 1)]
    assert constant_rows(spark, [], "x string").count() == 0
    grouper = all_queries()["clean_grouper_codes"](spark, SMALL)
    assert "ExistingRDD" not in grouper._jdf.queryExecution().executedPlan().toString()
