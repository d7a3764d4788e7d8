"""Stand-in health-record tables derived from a star-schema data set.

Customers play persons, order lines play clinical events, orders play visits
and parts play the vocabulary.  Every table grows with the given data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.session import constant_rows, materialize
from cohortweave.settings import (
    COMORBIDITY_CODESETS,
    ECMO_CODESET,
    VENTILATION_CODESET,
)
from cohortweave.sources.tables import Split, Tables

# --- Fixed values: (codeset, name, modulus, remainder) of the stand-in codesets ---
STANDIN_CODESETS = [
    *[(codeset, f"cci_{i + 1:02d}", 40, i) for i, codeset in enumerate(COMORBIDITY_CODESETS)],
    (VENTILATION_CODESET, "vent", 101, 3),
    (ECMO_CODESET, "ecmo", 199, 5),
    (339287218, "paxlovid", 50, 1),
    (96369749, "remdesivir", 50, 2),
    (487953007, "bebtelovimab", 50, 3),
    (38048732, "baricitinib", 50, 4),
    (697105949, "vaccine", 5, 0),
]
# --- end of fixed values ---


def halves(df: DataFrame, **changed: Column) -> Split:
    """Two overlapping parts by person.

    The records of every other held-out person are in both parts; the held-out
    copy of those has the ``changed`` values, which must never count.
    """
    person = F.col("person_id")
    test = df.filter(person % 5 == 0).select(
        *[
            F.when(person % 10 == 0, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c
            for c in df.columns
        ]
    )
    return Split(train=df.filter((person % 5 != 0) | (person % 10 == 0)), test=test)


def _person(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS person_id",
        "IF(c_custkey % 50 = 0, NULL, CAST(1910 + (c_custkey * 7) % 80 AS INT)) AS year_of_birth",
        "CAST(1 + c_custkey % 12 AS INT) AS month_of_birth",
        "c_custkey % 97 = 0 AS is_age_90_or_older",
        """CASE c_custkey % 9
             WHEN 0 THEN 'Black' WHEN 1 THEN 'Black or African American'
             WHEN 2 THEN 'Multiple races' WHEN 3 THEN 'Asian Indian' WHEN 4 THEN 'Asian'
             WHEN 5 THEN 'No information' WHEN 7 THEN 'White'
             WHEN 8 THEN 'Native Hawaiian or Other Pacific Islander' END AS race_concept_name""",
        """CASE c_nationkey % 4
             WHEN 0 THEN 'Not Hispanic or Latino' WHEN 1 THEN 'Hispanic or Latino'
             WHEN 2 THEN 'No matching concept' END AS ethnicity_concept_name""",
        """CASE WHEN c_custkey % 40 = 0 THEN 'UNKNOWN' WHEN c_custkey % 2 = 0 THEN 'MALE'
             ELSE 'FEMALE' END AS gender_concept_name""",
    )


def _outcome(customer: DataFrame) -> Split:
    key = F.col("c_custkey")
    day = F.expr("DATE_ADD(DATE'1998-01-01', CAST((c_custkey * 37) % 700 AS INT))")
    train = customer.filter(key % 5 != 0).select(
        key.alias("person_id"),
        day.alias("covid_index"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("pasc_code_after_four_weeks"),
        (key % 33 == 1).cast("int").alias("pasc_code_prior_four_weeks"),
    )
    test = customer.filter(key % 5 == 0).select(
        key.alias("person_id"), day.alias("covid_index")
    )
    return Split(train, test)


_CODE = "CONCAT('A', LPAD(CAST(p_size AS STRING), 2, '0'))"


def _concept(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS concept_id",
        "CONCAT(p_name, ' ', p_brand) AS concept_name",
        f"""CONCAT({_CODE}, IF(p_partkey % 2 = 0,
                CONCAT('.', CAST(p_partkey % 10 AS STRING)), '')) AS concept_code""",
        "IF(p_type = 'PROMO', 'Drug', 'Condition') AS domain_id",
        "IF(p_partkey % 3 = 0, 'ICD10CM', 'SNOMED') AS vocabulary_id",
        "IF(p_partkey % 41 = 0, 'D', NULL) AS invalid_reason",
    )


def _relationship(part: DataFrame) -> DataFrame:
    """Up to four links per part, from one scan."""
    key = F.col("p_partkey")

    def link(first: Column, second: Column, relation: str) -> Column:
        return F.struct(
            first.alias("concept_id_1"),
            second.alias("concept_id_2"),
            F.lit(relation).alias("relationship_id"),
        )

    links = F.array(
        link(key, key + 1, "Maps to"),
        F.when(key % 2 == 0, link(key, key + 4, "Maps to")),
        link(key, key, "Maps to"),
        link(key + 1, key, "Mapped from"),
    )
    return part.select(F.inline(F.array_compact(links)))


def _grouper(part: DataFrame) -> DataFrame:
    rows = part.filter("p_size <= 45").selectExpr(
        f"""CONCAT("'", {_CODE}, IF(p_partkey % 2 = 0,
              CAST(p_partkey % 10 AS STRING), ''), "'") AS `ICD-10-CM_CODE`""",
        """CONCAT("'", CASE p_size % 10
              WHEN 1 THEN CONCAT('PRG', LPAD(CAST(p_size AS STRING), 3, '0'))
              WHEN 2 THEN 'XXX111' ELSE CONCAT('CIR00', CAST(p_size % 10 AS STRING)) END, "'")
              AS Default_CCSR_CATEGORY_OP""",
    )
    extra = constant_rows(part.sparkSession, [("'Z99'", "'FAC001'")], rows.schema)
    return rows.distinct().unionAll(extra)


def _codesets(part: DataFrame) -> DataFrame:
    sets = F.array(
        *[
            F.struct(
                F.lit(codeset).cast("bigint").alias("codeset_id"),
                F.lit(name).alias("concept_set_name"),
                F.lit(modulus).alias("m"),
                F.lit(remainder).alias("r"),
            )
            for codeset, name, modulus, remainder in STANDIN_CODESETS
        ]
    )
    return (
        part.select(F.col("p_partkey").alias("concept_id"), F.inline(sets))
        .filter(F.col("concept_id") % F.col("m") == F.col("r"))
        .select("codeset_id", "concept_set_name", "concept_id")
    )


def _event_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One event per (order, line number); repeated lines are merged.

    The one-letter flag is compared by its character code, which keeps the
    aggregate on fixed-width values (hash aggregation instead of sorting).
    Lines meet their order first, so that they are merged where the join put them.
    Rows are sorted within a task by what the parts of the event tables filter, so
    that a reader of a part skips the pages of the others.
    """
    by_order = orders.groupBy("o_orderkey").agg(F.min("o_custkey").alias("person_id"))
    lines = (
        lineitem.join(by_order, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("person_id").alias("person_id"),
            F.min("l_partkey").alias("concept_id"),
            F.min("l_shipdate").alias("shipped"),
            F.min(F.ascii("l_returnflag")).alias("flag"),
            F.min("l_suppkey").alias("supplier"),
        )
    )
    kind = F.col("supplier") % 3
    return lines.sortWithinPartitions(kind, "flag").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "person_id",
        "concept_id",
        F.to_date("shipped").alias("event_date"),
        F.char("flag").alias("flag"),
        kind.alias("kind"),
    )


def _visits(orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderstatus = 'F' AND o_custkey % 7 <> 0").selectExpr(
        "o_orderkey AS visit_occurrence_id",
        "o_custkey AS person_id",
        "CAST(o_orderdate AS DATE) AS visit_start_date",
        "DATE_ADD(CAST(o_orderdate AS DATE), CAST(o_orderkey % 5 AS INT)) AS visit_end_date",
        """IF(o_orderkey % 3 = 0, DATE_SUB(CAST(o_orderdate AS DATE), 2), NULL)
             AS macrovisit_start_date""",
        """IF(o_orderkey % 3 = 0, DATE_ADD(CAST(o_orderdate AS DATE), 30), NULL)
             AS macrovisit_end_date""",
        """CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'Inpatient Visit'
             WHEN o_orderpriority = '2-HIGH' THEN 'Emergency Room Visit'
             WHEN o_orderpriority <> '5-LOW' OR o_orderpriority IS NULL THEN 'Outpatient Visit'
             END AS visit_concept_name""",
    )


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    @cache
    def given(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cache
    def lines() -> DataFrame:
        """Written once: ten parts of event tables read them, most of them more than once."""
        return materialize(_event_lines(given("lineitem"), given("orders")), "event-lines")

    def events(kept: str, prefix: str, id_col: str, date_col: str) -> Callable[[], Split]:
        return lambda: halves(
            lines()
            .filter(kept)
            .select(
                F.col("id").alias(id_col),
                "person_id",
                F.col("concept_id").alias(f"{prefix}_concept_id"),
                F.col("event_date").alias(date_col),
            ),
            person_id=F.col("person_id") + F.col(id_col) % 3,
            **{
                f"{prefix}_concept_id": F.col(f"{prefix}_concept_id") + 1,
                date_col: F.date_sub(F.col(date_col), 300),
            },
        )

    return Tables(
        concept=lambda: _concept(given("part")),
        concept_relationship=lambda: _relationship(given("part")),
        grouper=lambda: _grouper(given("part")),
        concept_set_members=lambda: _codesets(given("part")),
        condition_era=events(
            "flag = 'A' AND person_id % 20 <> 3",
            "condition", "condition_era_id", "condition_era_start_date",
        ),
        drug_era=events(
            "flag = 'R' OR id % 4 = 0", "drug", "drug_era_id", "drug_era_start_date"
        ),
        procedure=events("kind = 0", "procedure", "procedure_occurrence_id", "procedure_date"),
        observation=events("kind = 1", "observation", "observation_id", "observation_date"),
        condition=events(
            "kind = 2", "condition", "condition_occurrence_id", "condition_start_date"
        ),
        visit=lambda: halves(
            _visits(given("orders")),
            visit_start_date=F.date_add("visit_start_date", 200),
            visit_concept_name=F.lit("Inpatient Visit"),
        ),
        person=lambda: halves(
            _person(given("customer")),
            year_of_birth=F.lit(1900),
            race_concept_name=F.lit("Asian"),
        ),
        outcome=lambda: _outcome(given("customer")),
    )
