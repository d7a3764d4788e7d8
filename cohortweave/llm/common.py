"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20

#: ``[\x20\x09-\x0D]``: what separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\t-\\r]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else ``df`` has.

    Columns are found by position: an exact match first, else the first match in
    any case, so further columns whose names clash (``Text`` beside ``text``, or
    a name twice) cause no ambiguity.
    """
    places = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        folded = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not folded:
            raise ValueError(f"no column {name!r} among {df.columns}")
        places.append((exact or folded)[0])
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(places, names)])


def settled(**columns: Column) -> Column:
    """A generator of one row with the named columns, for ``select``.

    Filters on generated columns stay above the generator.  Without it, Spark moves a filter below
    the projections and puts their expressions in place of their names, and what is
    costly is computed again for every use, even for every element of an array.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of one batch sent to a Python worker, so that long texts don't pile up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    given = int(now.rstrip("bB")) if now and now.rstrip("bB").isdigit() else 0
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def digest_key(text: Column) -> Column:
    """120 bits of the md5 of a text, as a number that hash aggregates can hold."""
    digest = F.md5(text.cast("binary"))

    def bits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    return (bits(1) * F.lit(1 << 60).cast("decimal(19,0)") + bits(16)).cast("decimal(38,0)")
