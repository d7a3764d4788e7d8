"""The whole cohort build as one lazily assembled set of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from cohortweave.operators import boosting, cohort, comorbidity, eras, gradient_trees, labels
from cohortweave.operators import medications, persons, severity, vocabulary
from cohortweave.operators.joins import hot_keys
from cohortweave.operators.stacking import stack_splits
from cohortweave.session import materialize
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings
from cohortweave.sources.schemas import CONDITIONS, OBSERVATIONS, PROCEDURES
from cohortweave.sources.tables import Tables, stored_or, write_table

SEVERITIES = (severity.MILD, severity.MODERATE, severity.SEVERE)
STEPS = (
    "mapped_concepts",
    "condition_mapped",
    "icd_match",
    "person_all",
    "covid_severity",
    "medications_vaccinations",
    "cci_count",
    "label_frequency",
    "conditions_only",
    "cohort",
    "model_matrix",
)


@dataclass(frozen=True)
class Predictions:
    trials: DataFrame
    model: DataFrame
    scores: DataFrame
    importance: DataFrame


class CohortBuild:
    """Steps of the build as properties; each is a plan until it is used.

    ``stored_mapping`` may name a stored concept mapping to use in place of
    computing it.
    """

    def __init__(
        self,
        tables: Tables,
        settings: CohortSettings = DEFAULT_SETTINGS,
        stored_mapping: str | None = None,
    ):
        self.tables = tables
        self.settings = settings
        self.stored_mapping = stored_mapping
        self.ventilation_tables = [
            (PROCEDURES, tables.procedure),
            (OBSERVATIONS, tables.observation),
            (CONDITIONS, tables.condition),
        ]
        self.ecmo_tables = self.ventilation_tables[:2]

    @cached_property
    def mapped_concepts(self) -> DataFrame:
        t = self.tables
        return stored_or(
            t.concept.sparkSession,
            self.stored_mapping,
            lambda: vocabulary.mapped_concepts(t.concept_relationship, t.concept, t.grouper),
        )

    @cached_property
    def condition_eras(self) -> DataFrame:
        split = self.tables.condition_era
        return stack_splits(split.train, split.test, "condition_era_id")

    @cached_property
    def condition_mapped(self) -> DataFrame:
        return vocabulary.map_conditions(self.condition_eras, self.mapped_concepts)

    @cached_property
    def icd_match(self) -> DataFrame:
        return eras.icd_match(
            self.condition_eras,
            self.mapped_concepts,
            self.settings,
            concept=self.tables.concept,
        )

    @cached_property
    def person_all(self) -> DataFrame:
        return persons.person_all(self.tables.person, self.tables.outcome, self.settings)

    @cached_property
    def index(self) -> DataFrame:
        """Index date per person, written once: severity, drugs and labels all read it."""
        return materialize(
            persons.index_dates(self.tables.person, self.tables.outcome), "index-dates"
        )

    @cached_property
    def severity_members(self) -> DataFrame:
        """Members of the two severity codesets, written once: few of all."""
        codesets = [self.settings.ventilation_codeset, self.settings.ecmo_codeset]
        members = vocabulary.codeset_members(self.tables.concept_set_members, codesets)
        return materialize(members.select("codeset_id", "concept_id").distinct(), "severity-members")

    @cached_property
    def codeset_hits(self) -> DataFrame:
        """Events in the codesets of either kind, found in one go over the event tables."""
        return severity.codeset_hits(
            [
                (self.ventilation_tables, self.settings.ventilation_codeset),
                (self.ecmo_tables, self.settings.ecmo_codeset),
            ],
            self.severity_members,
            self.settings,
        )

    @cached_property
    def codeset_hits_hot(self) -> DataFrame:
        return hot_keys(self.codeset_hits, "person_id")

    @cached_property
    def visit_hot(self) -> DataFrame:
        return severity.person_hot_keys(self.tables.visit)

    @cached_property
    def severe_persons(self) -> DataFrame:
        return severity.severe_persons(
            self.ventilation_tables,
            self.ecmo_tables,
            self.index,
            self.severity_members,
            self.settings,
            hits=self.codeset_hits,
        )

    @cached_property
    def covid_severity(self) -> DataFrame:
        return severity.covid_severity(
            self.ventilation_tables,
            self.ecmo_tables,
            self.tables.visit,
            self.index,
            self.severity_members,
            self.settings,
            hits=self.codeset_hits,
        )

    @cached_property
    def medications_vaccinations(self) -> DataFrame:
        return medications.medications_vaccinations(
            self.tables.drug_era, self.index, self.tables.concept_set_members, self.settings
        )

    @cached_property
    def cci_count(self) -> DataFrame:
        """Every matched era with label and comorbidity count (row level)."""
        return comorbidity.cci_rows(
            self.icd_match,
            self.tables.concept_set_members,
            self.index,
            self.settings,
            hot=severity.person_hot_keys(self.tables.condition_era),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Condition history per person and category, written once.

        Three later steps read it (label frequencies, the matrix, the counts);
        it is far smaller than the eras it sums up.
        """
        plan = comorbidity.condition_history(
            self.tables.condition_era,
            self.mapped_concepts,
            self.tables.concept_set_members,
            self.settings,
        )
        return materialize(plan, "condition-history")

    @cached_property
    def person_labels(self) -> DataFrame:
        """Written once: the list of labels is collected before the matrix is built."""
        return materialize(
            comorbidity.history_labels(self.history, self.index), "person-labels"
        )

    @cached_property
    def label_frequency(self) -> DataFrame:
        return labels.label_frequency(self.person_labels, unique=True)

    @cached_property
    def minimum_persons(self) -> int:
        return labels.minimum_persons(self.index, self.settings)

    @cached_property
    def kept_labels(self) -> list[str]:
        return labels.label_list(self.label_frequency, self.minimum_persons)

    @cached_property
    def conditions_only(self) -> DataFrame:
        counts = comorbidity.history_counts(self.history)
        return labels.conditions_only(self.person_labels, counts, self.kept_labels)

    @cached_property
    def cohort(self) -> DataFrame:
        return cohort.assemble_cohort(
            self.person_all,
            self.conditions_only,
            self.medications_vaccinations,
            self.covid_severity,
        )

    @cached_property
    def model_matrix(self) -> DataFrame:
        """Severity labels are fixed; only the gender values are looked up,
        on the person table alone."""
        genders = cohort.categories(
            cohort.exclude_early_outcome(self.person_all), "gender_cats"
        )
        return cohort.model_matrix(
            self.cohort, known={"who_severity": SEVERITIES, "gender_cats": genders}
        )

    def save(self, folder: str, steps: Sequence[str] = STEPS, mode: str = "errorifexists") -> None:
        """Write the named steps below ``folder``, one table each.

        Later steps go on from the written tables instead of computing the
        earlier ones again.
        """
        for step in steps:
            plan = getattr(self, step)
            path = f"{folder.rstrip('/')}/{step}"
            write_table(plan, path, mode=mode)
            self.__dict__[step] = plan.sparkSession.read.schema(plan.schema).parquet(path)

    def predict(self, grid: list[boosting.TreeParams] | None = None, store: str | None = None) -> Predictions:
        """Search, refit on all labelled training persons and score the rest.

        Without ``grid`` the search proposes its own points.  Trials and the model go below ``store`` and are
        taken from there if an earlier call left them.
        """
        matrix = materialize(self.model_matrix, "model-matrix")
        trials = boosting.tune(matrix, grid, self.settings, store and f"{store}/trials")
        model, features, test = self.fit_final(matrix, boosting.best_params(trials), store)
        return Predictions(
            trials,
            model,
            gradient_trees.scores(test, model, features),
            gradient_trees.importance(model, features),
        )

    def fit_final(self, matrix: DataFrame, params: boosting.TreeParams, store: str | None = None):
        """(table of the model's nodes, feature names, held-out rows) for one parameter set."""
        train, test = cohort.split_blinded(matrix, self.tables.person.test)
        features = boosting.feature_columns(matrix)
        labelled = cohort.labelled_rows(train)
        return boosting.stored_model(labelled, params, features, store), features, test
