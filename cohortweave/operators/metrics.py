"""Stratified hold-out, class weights and classification metrics."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.ordering import RANGE_ROWS, running_below, with_range


def stratified_split(
    df: DataFrame,
    label: str,
    key: str = "person_id",
    fraction: float = 0.2,
    seed: int = 123,
) -> DataFrame:
    """Mark a fixed share of every class as hold-out (``is_holdout``).

    Rows of a class are ordered by a hash of seed and key, and the first
    ``fraction`` are held out.  Ranks are counted within ranges of the hash,
    whose number grows with the rows, and added up, so no task ever sees a
    whole class.  Rows without label or key belong to no class and are never
    held out.
    """
    share = Fraction(fraction).limit_denominator(10_000)
    placed = F.col(label).isNotNull() & F.col(key).isNotNull()
    n_rows, digits = df.count(), 1
    while 16**digits * RANGE_ROWS < n_rows:
        digits += 1
    hashed = df.filter(placed).withColumns(
        {"_hash": F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))),
         "_one": F.lit(1).cast("long")}
    ).withColumn("_range", F.substring("_hash", 1, digits))
    ranked = running_below(hashed, ["_hash", key], ["_one"], "_range", by=[label])
    held_out = (F.col("below__one") + 1) * share.denominator <= (
        F.col("total__one") * share.numerator
    )
    rest = df.filter(~placed).withColumn("is_holdout", F.lit(False))
    return ranked.select(*df.columns, held_out.alias("is_holdout")).unionByName(rest)


def class_weight(df: DataFrame, label: str, ratio: float) -> DataFrame:
    """Weight ``ratio`` for the positive class and 1 for the rest."""
    weight = F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0))
    return df.withColumn("class_weight", weight)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """tn, fp, fn and tp in one pass."""
    y, guess = F.col(actual), F.col(predicted)
    return df.agg(
        F.count_if((y == 0) & (guess == 0)).alias("tn"),
        F.count_if((y == 0) & (guess == 1)).alias("fp"),
        F.count_if((y == 1) & (guess == 0)).alias("fn"),
        F.count_if((y == 1) & (guess == 1)).alias("tp"),
    )


def binary_metrics(counts: DataFrame, *kept: str) -> DataFrame:
    """Metrics of hard 0/1 predictions from the confusion counts, beside the columns ``kept``.

    A ratio without denominator is 0; the AUC of hard predictions is the mean
    of both recall values and unknown when a class is absent.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return counts.select(
        *kept,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        F.when(
            (tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2
        ).alias("auc_hard"),
    )


def rank_auc(
    df: DataFrame, actual: str, score: str, rows_per_range: int = RANGE_ROWS
) -> DataFrame:
    """Exact area under the ROC curve of a score, ties counted half.

    Rows shrink to class counts per distinct score; the negatives below each
    score are added up over score ranges of about equal size.
    """
    y = F.col(actual)
    counts = (
        df.filter(y.isin(0, 1) & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    ranged = with_range(counts, "score", "_range", rows_per_range)
    ranked = running_below(ranged, ["score"], ["neg"], "_range")
    # counted in halves as exact decimals: products outgrow bigint at scale
    wide = "decimal(38,0)"
    won = F.col("pos").cast("decimal(18,0)") * (
        2 * F.col("below_neg") + F.col("neg")
    ).cast("decimal(19,0)")
    sums = ranked.agg(
        F.sum(won).cast(wide).alias("won"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    halves = 2 * F.col("p").cast("double") * F.col("n").cast("double")
    return sums.select(
        F.when(halves > 0, F.col("won").cast("double") / halves).alias("auc"),
        F.col("p").alias("positives"),
        F.col("n").alias("negatives"),
    )
