"""Typed reading and writing, and the bundle of tables one run needs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.operators.joins import lookup_join
from cohortweave.sources import schemas as S


@dataclass(frozen=True)
class Split:
    """The training and the held-out part of one table."""

    train: DataFrame
    test: DataFrame


class Tables:
    """The tables of one run, each loaded when it is first used.

    Plain tables: concept, concept_relationship, grouper, concept_set_members.
    Tables in two parts (``Split``): condition_era, drug_era, procedure,
    observation, condition, visit, person, outcome.
    """

    def __init__(self, **loaders: Callable[[], DataFrame | Split]):
        self._loaders = loaders

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        table = self._loaders[name]()
        setattr(self, name, table)
        return table


def file_columns(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the columns that a table's files hold."""
    if fmt == "parquet":
        return spark.read.parquet(path).columns
    if fmt != "csv":
        raise ValueError(f"unsupported format: {fmt}")
    return spark.read.option("header", True).csv(path).columns


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read the declared columns of a table with their declared types.

    Files may hold further columns in any order; the header names of a CSV file
    decide which column is which, and undeclared columns are read as text and
    pruned.  A value that does not fit its type, a CSV file whose header differs
    from the others of its folder and a declared column that is absent all
    fail the read.  Only the columns in ``schemas.OPTIONAL`` may be absent; they
    are null.
    """
    found = file_columns(spark, path, fmt)
    absent = [f.name for f in schema.fields if f.name not in found and f.name not in S.OPTIONAL]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    declared = {f.name: f.dataType for f in schema.fields}
    file_schema = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in found])
    rows = (
        spark.read.schema(file_schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(
        *[
            F.col(f"`{f.name}`") if f.name in found else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a result; by default an existing one is never replaced.

    CSV files get a header and keep spaces around values; an empty text is read back from them as null.
    """
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def add_concept_name(
    df: DataFrame,
    concept: DataFrame,
    id_col: str,
    out_col: str,
    *,
    spread: Sequence[str] | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Add the name of the concept in ``id_col`` (null when it is unknown).

    A whole vocabulary may be too large to broadcast; the names that occur in
    the column rarely are.  ``spread`` names a row id used to balance hot
    concepts if even those are; by default all columns serve.
    """
    names = concept.select(F.col("concept_id").alias(id_col), F.col("concept_name").alias(out_col))
    named = lookup_join(
        df, names, id_col, "left", spread=spread or df.columns, limit_bytes=limit_bytes
    )
    return named.select(*df.columns, out_col)


def add_concept_names(df: DataFrame, concept: DataFrame, ids: dict[str, str]) -> DataFrame:
    """Several names at once, given as {id column: name column}."""
    for id_col, out_col in ids.items():
        df = add_concept_name(df, concept, id_col, out_col)
    return df


def load_release(
    spark: SparkSession, root: str, fmt: str = "csv", event_names: bool = False
) -> Tables:
    """Load a release folder: shared tables in ``root``, parts below it.

    The parts are ``root/training`` and ``root/testing``.  Persons and visits
    get the concept names that later steps read, unless the files hold them.  Eras, procedures,
    observations and conditions get theirs only with ``event_names``: no step
    needs them on every row, and reports look them up on their results.
    """
    ending = f".{fmt}"

    def shared(name: str, schema: T.StructType) -> Callable[[], DataFrame]:
        return lambda: read_table(spark, f"{root}/{name}{ending}", schema, fmt)

    def parts(
        name: str,
        schema: T.StructType,
        *named: str,
        wanted: bool = True,
        test_schema: T.StructType | None = None,
    ) -> Callable[[], Split]:
        names = {f"{column}_id": f"{column}_name" for column in named if wanted}

        def part(folder: str, columns: T.StructType) -> DataFrame:
            path = f"{root}/{folder}/{name}{ending}"
            ready = {i: n for i, n in names.items() if n in file_columns(spark, path, fmt)}
            # a ready name takes the place of its id and is not looked up
            fields = [
                T.StructField(ready[f.name], T.StringType()) if f.name in ready else f
                for f in columns.fields
            ]
            rows = read_table(spark, path, T.StructType(fields), fmt)
            looked_up = {i: n for i, n in names.items() if i not in ready}
            return add_concept_names(rows, tables.concept, looked_up)

        return lambda: Split(part("training", schema), part("testing", test_schema or schema))

    def events(name: str, schema: T.StructType, named: str) -> Callable[[], Split]:
        return parts(name, schema, named, wanted=event_names)

    tables = Tables(
        concept=shared("concept", S.CONCEPT),
        concept_relationship=shared("concept_relationship", S.CONCEPT_RELATIONSHIP),
        grouper=shared("DXCCSR_v2021", S.GROUPER),
        concept_set_members=shared("concept_set_members", S.CONCEPT_SET_MEMBERS),
        condition_era=events("condition_era", S.CONDITION_ERA, "condition_concept"),
        drug_era=events("drug_era", S.DRUG_ERA, "drug_concept"),
        procedure=events("procedure_occurrence", S.PROCEDURE_OCCURRENCE, "procedure_concept"),
        observation=events("observation", S.OBSERVATION, "observation_concept"),
        condition=events("condition_occurrence", S.CONDITION_OCCURRENCE, "condition_concept"),
        visit=parts("microvisits_to_macrovisits", S.VISIT, "visit_concept"),
        person=parts(
            "person", S.PERSON, "race_concept", "ethnicity_concept", "gender_concept"
        ),
        outcome=parts(
            "long_covid_silver_standard", S.OUTCOME_TRAIN, test_schema=S.OUTCOME_TEST
        ),
    )
    return tables


def stored_or(
    spark: SparkSession,
    path: str | None,
    build: Callable[[], DataFrame],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """A stored table if ``path`` is given and present, else ``build()``.

    CSV needs the ``schema`` that the table was written with.
    """
    if path is not None:
        try:
            if fmt == "csv":
                return read_table(spark, path, schema, fmt)
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return build()
