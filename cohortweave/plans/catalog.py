"""Every operator as a query over the stand-in tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators import boosting, cohort, comorbidity, eras, labels
from cohortweave.operators import medications, metrics, persons, severity, vocabulary
from cohortweave.operators.stacking import stack_splits
from cohortweave.plans.build import CohortBuild
from cohortweave.session import materialize, new_path, shared_folder
from cohortweave.settings import STANDIN_SETTINGS as SETTINGS
from cohortweave.sources.schemas import schema_of
from cohortweave.sources.standin import standin_tables
from cohortweave.sources.tables import add_concept_name, read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

LABELS_SCHEMA = schema_of("doc_id bigint, quality int, toxic int")
ORDERS_SCHEMA = schema_of(
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate date, o_orderpriority string"
)


def query(fn: Callable[[CohortBuild], DataFrame]) -> Callable[[CohortBuild], DataFrame]:
    """Register a query over the stand-in health records."""
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(
        CohortBuild(standin_tables(spark, sf_dir), SETTINGS)
    )
    return fn


def table_query(fn: Query) -> Query:
    """Register a query that reads a given table directly."""
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- sources, stacking, enrichment -------------------------------------------------


@table_query
def scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/labels.parquet", LABELS_SCHEMA)


@table_query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV files with a header and read back with declared types."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    typed = orders.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ORDERS_SCHEMA.fields]
    )
    path = new_path(spark, "orders-csv")
    write_table(typed, path, "csv")
    return read_table(spark, path, ORDERS_SCHEMA, "csv")


@query
def stack_splits_persons(b: CohortBuild) -> DataFrame:
    return stack_splits(b.tables.person.train, b.tables.person.test, "person_id")


@query
def stack_outcomes_missing_cols(b: CohortBuild) -> DataFrame:
    return stack_splits(b.tables.outcome.train, b.tables.outcome.test, "person_id")


@query
def enrich_concept_name(b: CohortBuild) -> DataFrame:
    return add_concept_name(
        b.condition_eras,
        b.tables.concept,
        "condition_concept_id",
        "condition_concept_name",
        spread=["condition_era_id"],
    )


@query
def codeset_filter(b: CohortBuild) -> DataFrame:
    return vocabulary.codeset_members(
        b.tables.concept_set_members, SETTINGS.comorbidity_codesets
    )


# ---- vocabulary --------------------------------------------------------------------


@query
def maps_to_non_self(b: CohortBuild) -> DataFrame:
    return vocabulary.maps_to(b.tables.concept_relationship)


@query
def clean_source_codes(b: CohortBuild) -> DataFrame:
    return vocabulary.source_codes(b.tables.concept)


@query
def clean_grouper_codes(b: CohortBuild) -> DataFrame:
    return vocabulary.clean_grouper(b.tables.grouper)


@query
def mapped_concepts(b: CohortBuild) -> DataFrame:
    return b.mapped_concepts


@query
def condition_mapped(b: CohortBuild) -> DataFrame:
    return b.condition_mapped


# ---- one category per era ----------------------------------------------------------


def _recoded(b: CohortBuild) -> DataFrame:
    return eras.recode_categories(b.condition_mapped, SETTINGS).select(
        "condition_era_id",
        "person_id",
        "condition_concept_id",
        "condition_era_start_date",
        "icd10cm_clean",
        eras.CATEGORY,
    )


@query
def recode_category(b: CohortBuild) -> DataFrame:
    return _recoded(b)


@query
def drop_unusable_category(b: CohortBuild) -> DataFrame:
    return eras.drop_unusable(_recoded(b), SETTINGS)


@query
def era_category_distinct(b: CohortBuild) -> DataFrame:
    return eras.distinct_era_categories(eras.drop_unusable(_recoded(b), SETTINGS))


@query
def icd_match(b: CohortBuild) -> DataFrame:
    return b.icd_match


# ---- demographics ------------------------------------------------------------------


def _person_outcome(b: CohortBuild) -> DataFrame:
    return persons.person_outcome(b.tables.person, b.tables.outcome)


@query
def person_outcome(b: CohortBuild) -> DataFrame:
    return _person_outcome(b)


@query
def age_at_index(b: CohortBuild) -> DataFrame:
    return persons.age_at_index(_person_outcome(b), SETTINGS).select(
        "person_id", "date_of_birth", persons.AGE
    )


@query
def age_without_cap_flag(b: CohortBuild) -> DataFrame:
    return persons.age_at_index(_person_outcome(b), SETTINGS, use_flag=False).select(
        "person_id", "date_of_birth", persons.AGE
    )


@query
def impute_age_median(b: CohortBuild) -> DataFrame:
    aged = persons.age_at_index(_person_outcome(b), SETTINGS)
    return persons.impute_median(aged.select("person_id", persons.AGE), persons.AGE)


@query
def race_group(b: CohortBuild) -> DataFrame:
    return persons.group_race(_person_outcome(b)).select(
        "person_id", "race_concept_name", "race_cats"
    )


@query
def ethnicity_group(b: CohortBuild) -> DataFrame:
    return persons.group_ethnicity(_person_outcome(b)).select(
        "person_id", "ethnicity_concept_name", "ethnicity_cats"
    )


@query
def gender_group(b: CohortBuild) -> DataFrame:
    return persons.group_gender(_person_outcome(b)).select(
        "person_id", "gender_concept_name", "gender_cats"
    )


@query
def race_counts(b: CohortBuild) -> DataFrame:
    return persons.value_counts(persons.group_race(_person_outcome(b)), "race_cats")


@query
def person_all(b: CohortBuild) -> DataFrame:
    return b.person_all


# ---- severity ----------------------------------------------------------------------


@query
def events_since_index(b: CohortBuild) -> DataFrame:
    """Procedures, observations and conditions since the look-back start."""
    found = None
    for columns, split in b.ventilation_tables:
        unique = stack_splits(split.train, split.test, columns.id)
        part = severity.events_since_index(
            severity.common_columns(unique, columns),
            b.index,
            SETTINGS,
            hot=severity.person_hot_keys(split),
        )
        found = part if found is None else found.unionByName(part)
    return found


def _vent(b: CohortBuild) -> DataFrame:
    return severity.codeset_events(
        b.ventilation_tables, b.index, b.severity_members,
        SETTINGS.ventilation_codeset, SETTINGS, hits=b.codeset_hits, hot=b.codeset_hits_hot,
    )


def _ecmo(b: CohortBuild) -> DataFrame:
    return severity.codeset_events(
        b.ecmo_tables, b.index, b.severity_members,
        SETTINGS.ecmo_codeset, SETTINGS, hits=b.codeset_hits, hot=b.codeset_hits_hot,
    )


@query
def vent_events(b: CohortBuild) -> DataFrame:
    return _vent(b)


@query
def ecmo_events(b: CohortBuild) -> DataFrame:
    return _ecmo(b)


def _both(b: CohortBuild, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    vent = report(_vent(b)).withColumn("codeset", F.lit("ventilation"))
    return vent.unionByName(report(_ecmo(b)).withColumn("codeset", F.lit("ecmo")))


@query
def codeset_usage(b: CohortBuild) -> DataFrame:
    """Rows per codeset, source and concept name."""
    return _both(b, lambda events: severity.codeset_usage(events, b.tables.concept))


@query
def codeset_persons(b: CohortBuild) -> DataFrame:
    """Distinct persons per codeset and source."""
    return _both(b, severity.codeset_persons)


def _severe(b: CohortBuild) -> DataFrame:
    return b.severe_persons


@query
def severe_persons(b: CohortBuild) -> DataFrame:
    return _severe(b)


def _visits(b: CohortBuild) -> DataFrame:
    return stack_splits(b.tables.visit.train, b.tables.visit.test, "visit_occurrence_id")


def _qualifying(b: CohortBuild) -> DataFrame:
    return severity.qualifying_visits(
        _visits(b), b.index, SETTINGS, hot=b.visit_hot
    )


@query
def visits_not_severe(b: CohortBuild) -> DataFrame:
    return severity.exclude_persons(
        _visits(b), _severe(b), hot=b.visit_hot
    )


@query
def qualifying_visits(b: CohortBuild) -> DataFrame:
    return _qualifying(b)


def _not_severe(b: CohortBuild) -> DataFrame:
    return severity.exclude_persons(
        _qualifying(b), _severe(b), hot=b.visit_hot
    )


def _visit_severity(b: CohortBuild) -> DataFrame:
    return severity.visit_severity(_not_severe(b))


@query
def visit_severity(b: CohortBuild) -> DataFrame:
    return _visit_severity(b)


@query
def visit_name_list(b: CohortBuild) -> DataFrame:
    return severity.visit_name_list(_not_severe(b))


@query
def visit_name_text(b: CohortBuild) -> DataFrame:
    """The visit names of every person as text, in numbered segments."""
    return severity.visit_name_segments(severity.visit_name_list(_not_severe(b)))


@query
def no_visit_persons(b: CohortBuild) -> DataFrame:
    return severity.persons_without_label(b.index, _severe(b), _visit_severity(b))


@query
def covid_severity(b: CohortBuild) -> DataFrame:
    return b.covid_severity


# ---- medications -------------------------------------------------------------------


def _drug_flags(b: CohortBuild) -> DataFrame:
    drugs = stack_splits(b.tables.drug_era.train, b.tables.drug_era.test, "drug_era_id")
    return medications.codeset_flags(drugs, b.tables.concept_set_members, SETTINGS)


@query
def codeset_flags(b: CohortBuild) -> DataFrame:
    return _drug_flags(b)


@query
def drug_usage(b: CohortBuild) -> DataFrame:
    return medications.drug_usage(_drug_flags(b), SETTINGS)


@query
def vaccine_pre_post(b: CohortBuild) -> DataFrame:
    rows = medications.vaccine_pre_post(
        _drug_flags(b), b.index, SETTINGS, hot=severity.person_hot_keys(b.tables.drug_era)
    )
    return rows.select(
        "drug_era_id", "person_id", "covid_index", medications.PRE, medications.POST
    )


@query
def drug_sums(b: CohortBuild) -> DataFrame:
    return medications.drug_sums(
        b.tables.drug_era, b.index, b.tables.concept_set_members, SETTINGS
    )


@query
def medications_vaccinations(b: CohortBuild) -> DataFrame:
    return b.medications_vaccinations


# ---- comorbidity, labels, pivot ----------------------------------------------------


@query
def comorbidity_count(b: CohortBuild) -> DataFrame:
    return comorbidity.comorbidity_count(b.icd_match, b.tables.concept_set_members, SETTINGS)


@query
def pre_post_condition(b: CohortBuild) -> DataFrame:
    return comorbidity.pre_post_rows(
        b.icd_match, b.index, hot=severity.person_hot_keys(b.tables.condition_era)
    )


@query
def cci_count(b: CohortBuild) -> DataFrame:
    return b.cci_count


@query
def label_frequency(b: CohortBuild) -> DataFrame:
    return b.label_frequency


@query
def label_frequency_unpivot(b: CohortBuild) -> DataFrame:
    return labels.label_frequency_unpivot(b.person_labels, labels.label_list(b.label_frequency))


@query
def kept_labels(b: CohortBuild) -> DataFrame:
    """The labels that become columns of the matrix, derived at any scale."""
    return labels.kept_labels(b.label_frequency, b.minimum_persons)


@query
def drop_rare_labels(b: CohortBuild) -> DataFrame:
    rows = b.cci_count.select("condition_era_id", "person_id", comorbidity.LABEL)
    return labels.drop_rare_labels(
        rows, b.label_frequency, b.minimum_persons, spread=["condition_era_id"]
    )


@query
def binary_pivot(b: CohortBuild) -> DataFrame:
    kept = F.col(comorbidity.LABEL).isin(*b.kept_labels)
    return labels.binary_pivot(b.person_labels.filter(kept), b.kept_labels)


@query
def conditions_only(b: CohortBuild) -> DataFrame:
    return b.conditions_only


# ---- cohort and model matrix -------------------------------------------------------


@query
def cohort_features(b: CohortBuild) -> DataFrame:
    return b.cohort


@query
def exclude_early_outcome(b: CohortBuild) -> DataFrame:
    return cohort.exclude_early_outcome(b.cohort)


@query
def model_matrix(b: CohortBuild) -> DataFrame:
    return b.model_matrix


@query
def train_rows(b: CohortBuild) -> DataFrame:
    return cohort.split_blinded(b.model_matrix, b.tables.person.test)[0]


@query
def test_rows(b: CohortBuild) -> DataFrame:
    return cohort.split_blinded(b.model_matrix, b.tables.person.test)[1]


@query
def labelled_rows(b: CohortBuild) -> DataFrame:
    return cohort.labelled_rows(b.model_matrix)


# ---- model steps -------------------------------------------------------------------


@query
def stratified_split(b: CohortBuild) -> DataFrame:
    rows = cohort.labelled_rows(b.person_all).select("person_id", cohort.OUTCOME)
    return metrics.stratified_split(
        rows, cohort.OUTCOME, "person_id", SETTINGS.holdout_fraction, SETTINGS.split_seed
    )


@query
def class_weights(b: CohortBuild) -> DataFrame:
    rows = cohort.labelled_rows(b.person_all).select("person_id", cohort.OUTCOME)
    return metrics.class_weight(rows, cohort.OUTCOME, boosting.POS_WEIGHTS[0])


@table_query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scan_typed(spark, sf_dir), "toxic", "quality")


@table_query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_metrics(confusion_matrix(spark, sf_dir))


@table_query
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the length of a document ranks its ``toxic`` label."""
    lengths = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return metrics.rank_auc(
        scan_typed(spark, sf_dir).join(lengths, "doc_id"), "toxic", "n_chars"
    )


def _store(b: CohortBuild) -> str:
    """Where this session's model queries over the same matrix share their trials and model."""
    spark = b.model_matrix.sparkSession
    key = boosting.matrix_key(b.model_matrix)
    return f"{shared_folder(spark)}/search-{spark.sparkContext.applicationId}-{key}"


@query
def tuning_trials(b: CohortBuild) -> DataFrame:
    matrix = materialize(b.model_matrix, "model-matrix")
    b.__dict__["model_matrix"] = matrix
    return boosting.tune(matrix, None, SETTINGS, f"{_store(b)}/trials")


def _predictions(b: CohortBuild):
    b.__dict__["model_matrix"] = materialize(b.model_matrix, "model-matrix")
    return b.predict(store=_store(b))


@query
def risk_scores(b: CohortBuild) -> DataFrame:
    """Scores by the refit of the winning trial, walked down the stored nodes."""
    return _predictions(b).scores


@query
def feature_importance(b: CohortBuild) -> DataFrame:
    """Features of the refit of the winning trial, from the stored nodes."""
    return _predictions(b).importance
