"""Totals of everything ordered before a row, without one global sort task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import materialize

RANGE_ROWS = 1_000_000


def running_below(
    rows: DataFrame,
    order: Sequence[str],
    weights: Sequence[str],
    bucket: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``below_<w>`` and ``total_<w>`` for each weight column.

    ``bucket`` cuts the order into consecutive ranges.  Each range is summed
    within its own task; the range totals (one row per range and group) are
    accumulated separately and joined back where the ranges already lie.
    ``bucket`` and ``by`` must not be null.
    """
    group = [*by, bucket]
    earlier_ranges = (
        Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_rows = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    totals = rows.groupBy(*group).agg(*[F.sum(w).alias(w) for w in weights])
    offsets = totals.select(
        *group,
        *[F.coalesce(F.sum(w).over(earlier_ranges), zero).alias(f"_before_{w}") for w in weights],
        *[F.sum(w).over(Window.partitionBy(*by)).alias(f"total_{w}") for w in weights],
    )
    inside = rows.select(
        "*", *[F.coalesce(F.sum(w).over(earlier_rows), zero).alias(f"_inside_{w}") for w in weights]
    )
    joined = inside.join(offsets, group)
    return joined.select(
        *rows.columns,
        *[(F.col(f"_before_{w}") + F.col(f"_inside_{w}")).alias(f"below_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


def with_range(rows: DataFrame, column: str, bucket: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Number consecutive ranges of ``column`` that hold about equally many ``rows``.

    There are as many ranges as the rows need, one partition each.  The ranges are
    written with the rows, so every reader sees the same ones; where they
    are cut balances the work and never changes a result.
    """
    ranges = max(1, -(-rows.count() // rows_per_range))
    ranged = rows.repartitionByRange(ranges, column).withColumn(bucket, F.spark_partition_id())
    return materialize(ranged, "ranges")
