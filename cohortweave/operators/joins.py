"""Joins that stay balanced: size-checked broadcast, else salted hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.session import materialize

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000
NULL_KEY_SALTS = 1 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows of ``df``, counted by a distributed aggregate."""
    fixed = 0
    variable = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.NumericType, T.DateType, T.BooleanType, T.TimestampType)):
            fixed += 8
        else:
            text = F.col(f"`{field.name}`").cast("string")
            variable.append(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            fixed += 8
    row_bytes = F.lit(fixed).cast("long")
    for size in variable:
        row_bytes = row_bytes + size
    return df.agg(F.sum(row_bytes)).first()[0] or 0


def fits_broadcast(df: DataFrame, limit_bytes: int | None = None) -> bool:
    if limit_bytes is None:
        limit_bytes = BROADCAST_LIMIT_BYTES
    return limit_bytes > 0 and measured_bytes(df) <= limit_bytes


def hot_keys(rows: DataFrame, key: str, min_rows: int | None = None) -> DataFrame:
    """All keys with more than ``min_rows`` rows and over how many tasks to
    spread them (``_copies``, about ``min_rows`` rows each).

    The list holds at most one key per ``min_rows`` rows.  It is counted once
    and kept in the shared folder, since both sides of a join read it.
    """
    if min_rows is None:
        min_rows = HOT_KEY_ROWS
    counted = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > min_rows)
        .select(key, F.ceil(F.col("_n") / F.lit(min_rows)).cast("int").alias("_copies"))
    )
    return materialize(counted, "hot-keys")


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "inner",
    *,
    spread: Sequence[str],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which each hot fact key is spread over several tasks.

    The number of tasks grows with the rows of the key, so its share of a task
    stays the same at any size.  The salt is a hash of the ``spread`` columns
    (a row id), not a random number: a task that runs again after an executor
    is lost sends each row to the same place.  Only the dimension rows of hot
    keys are replicated, together at most once per ``min_rows`` fact rows.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type: {how}")
    if hot is None:
        hot = hot_keys(fact.select(key), key)
    # a list too long to broadcast is joined by key like any other table
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    row_hash = F.xxhash64(*spread)
    salt = (
        F.when(F.col("_copies").isNotNull(), F.pmod(row_hash, F.col("_copies")))
        # null keys match nothing but may be many: spread without any copies
        .when(F.col(key).isNull(), F.pmod(row_hash, F.lit(NULL_KEY_SALTS)))
        .otherwise(F.lit(0))
        .cast("int")
    )
    last_copy = F.coalesce(F.col("_copies") - 1, F.lit(0))
    salted_fact = fact.join(hot, key, "left").withColumn("_salt", salt).drop("_copies")
    salted_dim = (
        dim.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last_copy)))
        .drop("_copies")
    )
    return salted_fact.join(salted_dim, [key, "_salt"], how).drop("_salt")


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    *,
    spread: Sequence[str],
    key_rows: DataFrame | None = None,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    fits: bool | None = None,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Join to a lookup table without moving the fact rows if possible.

    1. The table's measured size is within the limit: broadcast it.
    2. The part of it whose keys occur in ``fact`` is: broadcast that part.
    3. Otherwise ``skew_join``, after ``combine`` has merged equal fact rows
       (given by callers for which copies do not matter).

    ``key_rows`` may name a cheaper frame holding the fact's keys (such as the
    raw scan of that column) for steps 2 and 3.  ``fits`` passes on a
    measurement already made of ``dim`` or of a table that contains it.
    """
    if fits_broadcast(dim, limit_bytes) if fits is None else fits:
        return fact.join(F.broadcast(dim), key, how)
    keys = (fact if key_rows is None else key_rows).select(key)
    used = dim.join(keys.distinct(), key, "left_semi")
    if fits_broadcast(used, limit_bytes):
        return fact.join(F.broadcast(used), key, how)
    if combine is not None:
        fact = combine(fact)
    return skew_join(fact, dim, key, how, spread=spread, hot=hot_keys(keys, key))
