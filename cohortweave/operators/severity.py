"""Severity of the index illness: Severe, Moderate or Mild for every person."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.operators.joins import (
    fits_broadcast,
    hot_keys,
    lookup_join,
    skew_join,
)
from cohortweave.operators.stacking import stack_rows, stack_splits, stacked_hits
from cohortweave.operators.vocabulary import codeset_concepts
from cohortweave.session import materialize
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings
from cohortweave.sources.schemas import EventColumns
from cohortweave.sources.tables import Split

SEVERE, MODERATE, MILD = "Severe", "Moderate", "Mild"

EventTables = Sequence[tuple[EventColumns, Split]]


def common_columns(events: DataFrame, columns: EventColumns) -> DataFrame:
    """Any event table in one shape: source, event_id, person, concept, date."""
    return events.select(
        F.lit(columns.name).alias("source"),
        F.col(columns.id).alias("event_id"),
        "person_id",
        F.col(columns.concept).alias("concept_id"),
        F.col(columns.date).alias("event_date"),
    )


def lookback_start(index_date: Column, days: int) -> Column:
    return F.date_sub(index_date, days)


def events_since_index(
    events: DataFrame,
    index: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Events (common shape, unique) from the look-back start on, no upper end."""
    joined = skew_join(
        events, index, "person_id", "inner", spread=["source", "event_id"], hot=hot
    )
    return joined.filter(
        F.col("event_date") >= lookback_start(F.col("covid_index"), settings.lookback_days)
    )


def events_in_codesets(
    events: DataFrame,
    members: DataFrame,
    codesets: Sequence[int],
    *,
    fits: bool | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Events whose concept is in any of the codesets; equal copies may merge."""
    return lookup_join(
        events,
        codeset_concepts(members, codesets, "concept_id"),
        "concept_id",
        "left_semi",
        spread=["source", "event_id"],
        combine=DataFrame.distinct,
        fits=fits,
        limit_bytes=limit_bytes,
    ).select(*events.columns)


def codeset_hits(
    wanted: Sequence[tuple[EventTables, int]],
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Unique events (common shape) in any codeset that is wanted of their table, written once.

    The codeset filter runs on the raw scans, because it keeps little.  Each
    table is scanned once for all its codesets and once more for the copies of
    the records found (not if ``copies_agree``); only these are made unique by id.
    """
    of_table: dict[EventColumns, tuple[Split, list[int]]] = {}
    for tables, codeset in wanted:
        for columns, split in tables:
            of_table.setdefault(columns, (split, []))[1].append(codeset)
    every = sorted({codeset for _, codeset in wanted})
    fits = fits_broadcast(codeset_concepts(members, every, "concept_id"), limit_bytes)

    def in_codesets(rows: DataFrame, codesets: list[int]) -> DataFrame:
        return events_in_codesets(rows, members, codesets, fits=fits, limit_bytes=limit_bytes)

    parts = {
        columns: [common_columns(part, columns) for part in (split.train, split.test)]
        for columns, (split, _) in of_table.items()
    }
    found = {
        columns: [in_codesets(part, of_table[columns][1]) for part in both]
        for columns, both in parts.items()
    }
    if not settings.copies_agree:
        keys = [rows.select("source", "event_id") for both in found.values() for rows in both]
        ids = materialize(reduce(DataFrame.unionByName, keys).distinct(), "hit-ids")
        # if all ids may be broadcast, those of one table may
        ids_fit = fits_broadcast(ids, limit_bytes) or None
    events = []
    for columns, both in parts.items():
        if settings.copies_agree:
            events.append(stack_splits(*found[columns], key="event_id"))
            continue
        mine = ids.filter(F.col("source") == columns.name).select("event_id")
        copies = [
            lookup_join(
                part, mine, "event_id", "left_semi",
                spread=part.columns, fits=ids_fit, limit_bytes=limit_bytes,
            )
            for part in both
        ]
        unique = stack_splits(*copies, key="event_id")
        events.append(in_codesets(unique, of_table[columns][1]))
    return materialize(reduce(DataFrame.unionByName, events), "codeset-events")


def codeset_events(
    tables: EventTables,
    index: DataFrame,
    members: DataFrame,
    codeset: int,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hits: DataFrame | None = None,
    hot: DataFrame | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Events of several tables in one codeset since the look-back start.

    ``hits`` may name the ``codeset_hits`` of these tables and others, if this codeset was
    wanted of these tables, and ``hot`` their hot persons.
    """
    if hits is None:
        found = codeset_hits([(tables, codeset)], members, settings, limit_bytes=limit_bytes)
    else:
        mine = hits.filter(F.col("source").isin(*[columns.name for columns, _ in tables]))
        found = events_in_codesets(mine, members, [codeset], limit_bytes=limit_bytes)
    return events_since_index(found, index, settings, hot=hot)


def codeset_usage(events: DataFrame, concept: DataFrame) -> DataFrame:
    """Rows per source and concept name.

    Counted per concept id first; the name is looked up on the few counts.
    """
    counts = events.groupBy("source", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    names = concept.select("concept_id", "concept_name")
    return (
        counts.join(names, "concept_id", "left")
        .groupBy("source", "concept_name")
        .agg(F.sum("n").alias("n_rows"))
    )


def codeset_persons(events: DataFrame) -> DataFrame:
    """Distinct persons per source, and over all sources as ``all``."""
    seen = (
        events.select("source", "person_id")
        .distinct()
        .select(F.explode(F.array("source", F.lit("all"))).alias("source"), "person_id")
        .distinct()
    )
    return seen.groupBy("source").agg(F.count("person_id").alias("n_persons"))


def severe_persons(
    ventilation: EventTables,
    ecmo: EventTables,
    index: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hits: DataFrame | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Persons with ventilation or ECMO since the look-back start.

    Only the latest matching date of a person decides, so events shrink to one
    row per person, however many rows one person has.  ``hits`` may name the
    ``codeset_hits`` of both codesets.
    """
    if hits is None:
        wanted = [(ventilation, settings.ventilation_codeset), (ecmo, settings.ecmo_codeset)]
        hits = codeset_hits(wanted, members, settings, limit_bytes=limit_bytes)
    latest = hits.groupBy("person_id").agg(F.max("event_date").alias("_latest"))
    return (
        latest.join(index, "person_id")
        .filter(
            F.col("_latest") >= lookback_start(F.col("covid_index"), settings.lookback_days)
        )
        .select("person_id", F.lit(SEVERE).alias("who_severity"))
    )


def exclude_persons(
    visits: DataFrame, persons: DataFrame, *, hot: DataFrame | None = None
) -> DataFrame:
    """Visits of everyone but the given persons; hot persons are spread."""
    return skew_join(
        visits,
        persons.select("person_id").distinct(),
        "person_id",
        "left_anti",
        spread=["visit_occurrence_id"],
        hot=hot,
    ).select(*visits.columns)


def qualifying_visits(
    visits: DataFrame,
    index: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Visits starting since the look-back start, or covering the index date
    themselves or by their enclosing macro visit (ends included)."""
    joined = skew_join(
        visits, index, "person_id", "inner", spread=["visit_occurrence_id"], hot=hot
    )
    day = F.col("covid_index")
    return joined.filter(
        (F.col("visit_start_date") >= lookback_start(day, settings.lookback_days))
        | day.between(F.col("visit_start_date"), F.col("visit_end_date"))
        | day.between(F.col("macrovisit_start_date"), F.col("macrovisit_end_date"))
    ).select(*visits.columns, "covid_index")


def is_inpatient(name: Column) -> Column:
    return F.coalesce(name.contains("Inpatient"), F.lit(False))


def visit_severity(visits: DataFrame) -> DataFrame:
    """Moderate with any inpatient visit, else Mild; one bit per person."""
    return (
        visits.groupBy("person_id")
        .agg(F.max(is_inpatient(F.col("visit_concept_name"))).alias("_inpatient"))
        .select(
            "person_id", F.when(F.col("_inpatient"), MODERATE).otherwise(MILD).alias("who_severity")
        )
    )


def visit_name_list(visits: DataFrame) -> DataFrame:
    """Every visit name of a person with its number of visits.

    One row per person and name at any size; a person whose visits have no name
    has one row with a null name.  ``visit_name_text`` writes the list out.
    """
    named = F.col("visit_concept_name").isNotNull()
    counts = visits.groupBy("person_id", "visit_concept_name").agg(
        F.count(F.lit(1)).alias("n_visits")
    )
    some = Window.partitionBy("person_id")
    return (
        counts.withColumn("_named", F.max(named).over(some))
        .filter(named | ~F.col("_named"))
        .select("person_id", "visit_concept_name", "n_visits")
    )


def visit_name_text(names: DataFrame) -> DataFrame:
    """The list of a person as one sorted text, each name as often as it was visited.

    A reader for persons of interest: a text is as long as the person's list.
    """
    entry = F.when(
        F.col("visit_concept_name").isNotNull(), F.struct("visit_concept_name", "n_visits")
    )
    texts = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.array_join(
            F.array_repeat(e["visit_concept_name"], e["n_visits"].cast("int")), ", "
        ),
    )
    return names.groupBy("person_id").agg(
        F.array_join(texts, ", ").alias("concat_visit_concept_name")
    )


def visit_name_segments(names: DataFrame, segment_visits: int = 1000) -> DataFrame:
    """The sorted list of every person as numbered texts of at most ``segment_visits`` names each.

    Segment k holds the visits from ``k * segment_visits`` on, so the texts of a person, joined by
    ``", "`` in their order, are the person's ``visit_name_text``.  No task holds more of a
    list than its distinct names and one segment.  A person whose visits have no name has one empty text.
    """
    if segment_visits < 1:
        raise ValueError("a segment holds at least one visit")
    by_name = Window.partitionBy("person_id").orderBy("visit_concept_name")
    end = F.sum("n_visits").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stretch = names.select(
        "person_id", "visit_concept_name", (end - F.col("n_visits")).alias("_start"), end.alias("_end")
    )

    def segment_of(place: Column) -> Column:
        return F.floor(place / segment_visits).cast("long")

    pieces = stretch.select(
        "*", F.explode(F.sequence(segment_of(F.col("_start")), segment_of(F.col("_end") - 1))).alias("segment")
    )
    inside = F.least("_end", (F.col("segment") + 1) * segment_visits) - F.greatest(
        "_start", F.col("segment") * segment_visits
    )
    entry = F.when(
        F.col("visit_concept_name").isNotNull(),
        F.struct("visit_concept_name", inside.cast("int").alias("n")),
    )
    texts = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.array_join(F.array_repeat(e["visit_concept_name"], e["n"]), ", "),
    )
    # a person without names has one entry, however many the visits
    named = pieces.filter(F.col("visit_concept_name").isNotNull() | (F.col("segment") == 0))
    return named.groupBy("person_id", "segment").agg(
        F.array_join(texts, ", ").alias("concat_visit_concept_name")
    )


def persons_without_label(persons: DataFrame, *labelled: DataFrame) -> DataFrame:
    """Person ids found in none of the labelled frames."""
    rest = persons.select("person_id")
    for label in labelled:
        rest = rest.join(label.select("person_id"), "person_id", "left_anti")
    return rest


def inpatient_persons(
    visit: Split, index: DataFrame, settings: CohortSettings = DEFAULT_SETTINGS
) -> DataFrame:
    """Persons with a qualifying inpatient visit.

    The three qualifying conditions all say that the index date lies in a span
    of days: up to look-back days after the visit start, within the visit, or
    within the macro visit.  Keeping the latest end per (person, span start)
    answers the question exactly and bounds the rows of one person by the
    number of calendar days, before anything is shuffled.
    """
    needed = [
        "visit_occurrence_id", "person_id", "visit_start_date", "visit_end_date",
        "macrovisit_start_date", "macrovisit_end_date", "visit_concept_name",
    ]
    names = stacked_hits(
        visit.train.select(*needed),
        visit.test.select(*needed),
        "visit_occurrence_id",
        lambda rows: rows.filter(is_inpatient(F.col("visit_concept_name"))),
        copies_agree=settings.copies_agree,
    )
    ever = F.to_date(F.lit("0001-01-01"))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("first_day"), end.alias("last_day"))

    spans = F.array(
        span(ever, F.date_add("visit_start_date", settings.lookback_days)),
        span(F.col("visit_start_date"), F.col("visit_end_date")),
        span(F.col("macrovisit_start_date"), F.col("macrovisit_end_date")),
    )
    longest = (
        names.select("person_id", F.inline(spans))
        .filter(F.col("first_day").isNotNull() & F.col("last_day").isNotNull())
        .groupBy("person_id", "first_day")
        .agg(F.max("last_day").alias("last_day"))
    )
    return (
        longest.join(index, "person_id")
        .filter(F.col("covid_index").between(F.col("first_day"), F.col("last_day")))
        .select("person_id")
        .distinct()
    )


def covid_severity(
    ventilation: EventTables,
    ecmo: EventTables,
    visit: Split,
    index: DataFrame,
    members: DataFrame,
    settings: CohortSettings = DEFAULT_SETTINGS,
    *,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Exactly one label per person of ``index``: the most severe that applies.

    Severe wins over any visit and every other person is Mild, so two flags
    joined to the persons replace the exclude / label / refill cascade.
    """
    severe = severe_persons(ventilation, ecmo, index, members, settings, hits=hits).select(
        "person_id", F.lit(True).alias("_severe")
    )
    moderate = inpatient_persons(visit, index, settings).withColumn("_inpatient", F.lit(True))
    return (
        index.select("person_id")
        .join(severe, "person_id", "left")
        .join(moderate, "person_id", "left")
        .select(
            "person_id",
            F.when(F.col("_severe"), SEVERE)
            .when(F.col("_inpatient"), MODERATE)
            .otherwise(MILD)
            .alias("who_severity"),
        )
    )


def person_hot_keys(split: Split) -> DataFrame:
    """Hot persons of an event table, counted on its person column alone."""
    return hot_keys(stack_rows(split.train.select("person_id"), split.test.select("person_id")),
                    "person_id")
