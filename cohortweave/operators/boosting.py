"""Search for the settings of the boosted trees, final fit, scores and importance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import asdict
from statistics import NormalDist

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators import gradient_trees
from cohortweave.operators.cohort import OUTCOME, labelled_rows
from cohortweave.operators.gradient_trees import TreeParams
from cohortweave.operators.metrics import binary_metrics, stratified_split
from cohortweave.session import materialize, shared_folder
from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings

# --- Fixed values: the search space (inclusive ranges and choices) ---
MAX_DEPTH = (3, 18)
GAMMA = (1.0, 9.0)
REG_ALPHA = (40, 180)
REG_LAMBDA = (0.0, 1.0)
COLSAMPLE = (0.5, 1.0)
MIN_CHILD_WEIGHT = (0, 10)
POS_WEIGHTS = (4, 5, 6, 7, 8)
N_TREES = 180
MODEL_SEED = 0
# --- end of fixed values ---
#: Ranges of whole and of real numbers, by name.
WHOLE = {"max_depth": MAX_DEPTH, "reg_alpha": REG_ALPHA, "min_child_weight": MIN_CHILD_WEIGHT}
REAL = {"gamma": GAMMA, "reg_lambda": REG_LAMBDA, "colsample_bytree": COLSAMPLE}
#: Trials fitted side by side, in the same jobs; also the steps in which the search looks back.
TRIALS_AT_ONCE = 50
#: Trials drawn at random before the search looks back, candidates per proposal, share of good trials.
STARTUP_TRIALS, CANDIDATES, GOOD_SHARE = 20, 24, 0.25
TRIAL_SCHEMA = (
    "trial int, max_depth int, gamma double, reg_alpha int, reg_lambda double, "
    "colsample_bytree double, min_child_weight int, scale_pos_weight int, "
    "n_estimators int, seed int, accuracy double, f1 double, precision double, "
    "recall double, auc_hard double, auc_score double, best_round int, trees int, loss double"
)


def uniform(seed: int, trial: int, name: str) -> float:
    """A number in [0, 1): the first 52 bits of the md5 of seed, trial and name."""
    return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)


def _at(name: str, u: float) -> int | float:
    """The value of a dimension at a share of its range."""
    if name in WHOLE:
        low, high = WHOLE[name]
        return low + int(u * (high - low + 1))
    if name in REAL:
        low, high = REAL[name]
        return low + u * (high - low)
    return POS_WEIGHTS[int(u * len(POS_WEIGHTS))]


DIMENSIONS = (*WHOLE, *REAL, "scale_pos_weight")


def random_point(trial: int, seed: int = 0, n_estimators: int = N_TREES) -> TreeParams:
    """The random point of a trial, whatever other trials there are."""
    values = {name: _at(name, uniform(seed, trial, name)) for name in DIMENSIONS}
    return TreeParams(n_estimators=n_estimators, seed=MODEL_SEED, **values)


def sample_param_grid(
    n: int = DEFAULT_SETTINGS.trials, seed: int = 0, n_estimators: int = N_TREES
) -> list[TreeParams]:
    """``n`` seeded random points of the search space."""
    return [random_point(trial, seed, n_estimators) for trial in range(n)]


class Parzen:
    """Density of a dimension: a bell around every value seen and a wide one around the middle.

    Bells are as wide as the gap to the farther neighbour, within bounds, and cut off at the range's ends.
    """

    def __init__(self, values: Sequence[float], low: float, high: float):
        self._low, self._high = low, high
        centres = sorted([*values, (low + high) / 2])
        least = (high - low) / min(100.0, 1.0 + len(centres))
        ends = [low, *centres, high]
        self._bells = []
        wide = False
        for i, c in enumerate(centres):
            width = min(max(c - ends[i], ends[i + 2] - c, least), high - low)
            if c == (low + high) / 2 and not wide:
                width, wide = high - low, True
            bell = NormalDist(c, width)
            self._bells.append((bell, bell.cdf(low), bell.cdf(high)))

    def draw(self, which: float, u: float) -> float:
        bell, below, upto = self._bells[min(int(which * len(self._bells)), len(self._bells) - 1)]
        share = min(max(below + u * (upto - below), 1e-12), 1 - 1e-12)
        return min(max(bell.inv_cdf(share), self._low), self._high)

    def density(self, x: float) -> float:
        return sum(b.pdf(x) / (upto - below) for b, below, upto in self._bells) / len(self._bells)


def propose(trial: int, history: Sequence[dict], seed: int = 0, n_estimators: int = N_TREES) -> TreeParams:
    """The point to try next, by tree-structured Parzen estimation over the finished trials.

    The best quarter (by loss, then trial) are good.  In every dimension, candidates are drawn from the density of
    good values; the one whose density among good values most exceeds that among the others is
    taken.  Depends on the trials alone, so a resumed search proposes the same points.
    """
    if len(history) < STARTUP_TRIALS:
        return random_point(trial, seed, n_estimators)
    ranked = sorted(history, key=lambda r: (r["loss"], r["trial"]))
    n_good = math.ceil(GOOD_SHARE * len(ranked))
    good, rest = ranked[:n_good], ranked[n_good:]
    values: dict[str, int | float] = {}
    for name in DIMENSIONS:
        draws = [
            (uniform(seed, trial, f"{name}:{i}:which"), uniform(seed, trial, f"{name}:{i}")) for i in range(CANDIDATES)
        ]
        seen = [r[name] for r in good], [r[name] for r in rest]
        if name == "scale_pos_weight":
            share = [[(v.count(c) + 1) / (len(v) + len(POS_WEIGHTS)) for c in POS_WEIGHTS] for v in seen]
            values[name] = max(POS_WEIGHTS, key=lambda c: (share[0][POS_WEIGHTS.index(c)] / share[1][POS_WEIGHTS.index(c)] * (0.5 + uniform(seed, trial, f"{name}:{c}")), -c))
            continue
        low, high = WHOLE[name] if name in WHOLE else REAL[name]
        # whole numbers are the middles of ranges of length one
        margin = 0.5 if name in WHOLE else 0.0
        inside, outside = (Parzen(v, low - margin, high + margin) for v in seen)
        found = [inside.draw(*d) for d in draws]
        best = max(found, key=lambda x: (inside.density(x) / outside.density(x), -x))
        values[name] = min(max(math.floor(best + 0.5), low), high) if name in WHOLE else best
    return TreeParams(n_estimators=n_estimators, seed=MODEL_SEED, **values)


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("person_id", OUTCOME)]


def training_rows(labelled: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[list[float]]]:
    """Binned rows for ``gradient_trees.Boosting``, written once, and the bins' edges.

    ``labelled`` may have ``is_holdout``; held-out rows don't shape the bins.
    """
    if "is_holdout" not in labelled.columns:
        labelled = labelled.withColumn("is_holdout", F.lit(False))
    edges = gradient_trees.bin_edges(labelled.filter("NOT is_holdout"), features)
    named = labelled.withColumn("label", F.col(OUTCOME).cast("int"))
    rows = gradient_trees.binned(named, features, edges, "person_id", "label", "is_holdout")
    return materialize(rows, "training-rows"), edges


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a completely written table."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _stored_trials(spark: SparkSession, path: str, points: dict[int, TreeParams]) -> dict[int, dict]:
    """Finished trials in a folder that have these parameters."""
    if not _finished(spark, path):
        return {}
    rows = [r.asDict() for r in spark.read.schema(TRIAL_SCHEMA).parquet(path).collect()]
    return {
        r["trial"]: r for r in rows if r["trial"] in points and asdict(points[r["trial"]]).items() <= r.items()
    }


def _trial_rows(spark: SparkSession, fits: Sequence[gradient_trees.Fit]) -> dict[int, dict]:
    """Finished trials: settings, best round, and metrics of the hold-out in that round."""
    counts = gradient_trees.local_frame(
        spark, [(f.number, *(f.confusion or (0, 0, 0, 0))) for f in fits], "trial int, tn long, fp long, fn long, tp long"
    )
    metrics = {r["trial"]: r.asDict() for r in binary_metrics(counts, "trial").collect()}
    rows = {}
    for fit in fits:
        hard = metrics[fit.number]["auc_hard"]
        rows[fit.number] = {
            **metrics[fit.number], **asdict(fit.params), "auc_score": fit.best_auc, "best_round": fit.best_round,
            "trees": fit.rounds, "loss": 1.0 - (hard if hard is not None else 0.0),
        }
    return rows


def _trials_frame(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return gradient_trees.local_frame(spark, [tuple(r[n] for n in names) for r in rows], schema)


def tune(
    matrix: DataFrame,
    grid: Sequence[TreeParams] | None = None,
    settings: CohortSettings = DEFAULT_SETTINGS,
    store: str | None = None,
    at_once: int | None = None,
) -> DataFrame:
    """One row per trial, best first (``rank`` 1): parameters and metrics.

    The trials are the points of ``grid``, else ``settings.trials`` points that ``propose`` finds,
    looking back after every ``at_once`` trials, which are fitted side by side.  Each boosts until the rank
    AUC of the hold-out has not risen for ten rounds and counts with its best round; the loss is one minus
    the AUC of the hard predictions.

    Trials are written below ``store`` as the fits that run side by side finish.  Those that an earlier search of the
    same matrix left there are not fitted again; without ``store`` they go to a new folder beside what
    ``materialize`` writes.
    """
    spark = matrix.sparkSession
    at_once = at_once or TRIALS_AT_ONCE
    split = stratified_split(
        labelled_rows(matrix), OUTCOME, "person_id", settings.holdout_fraction, settings.split_seed
    )
    rows, edges = training_rows(split, feature_columns(matrix))
    folder = (store or f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}").rstrip("/")
    results: list[dict] = []
    n_trials = settings.trials if grid is None else len(grid)
    while len(results) < n_trials:
        numbers = range(len(results), min(len(results) + at_once, n_trials))
        points = {i: propose(i, results, n_estimators=settings.trees) if grid is None else grid[i] for i in numbers}
        path = f"{folder}/trials-{numbers[0]}"
        found = _stored_trials(spark, path, points)
        missing = {i: p for i, p in points.items() if i not in found}
        if missing:
            found |= _trial_rows(spark, gradient_trees.Boosting(rows, edges, missing).run())
            _trials_frame(spark, list(found.values()), TRIAL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        results += [found[i] for i in numbers]
    results.sort(key=lambda r: (r["loss"], r["trial"]))
    return _trials_frame(spark, [{"rank": i + 1, **r} for i, r in enumerate(results)], "rank int, " + TRIAL_SCHEMA)


def best_params(trials: DataFrame) -> TreeParams:
    """The winning trial's values (not indices into a list of choices)."""
    row = trials.filter("rank = 1").first().asDict()
    return TreeParams(**{name: row[name] for name in TreeParams.__dataclass_fields__})


def fit_boosted_trees(labelled: DataFrame, params: TreeParams, features: Sequence[str]) -> DataFrame:
    """The model of all labelled rows as a written table of nodes; ``is_holdout`` rows, if any, end the fit."""
    rows, edges = training_rows(labelled, features)
    (fit,) = gradient_trees.Boosting(rows, edges, {0: params}).run()
    return materialize(gradient_trees.model_table(rows.sparkSession, fit), "risk-model")


def stored_model(
    labelled: DataFrame, params: TreeParams, features: Sequence[str], store: str | None = None
) -> DataFrame:
    """The model of these settings from ``store``, else fitted and, with ``store``, written there."""
    if store is None:
        return fit_boosted_trees(labelled, params, features)
    spark = labelled.sparkSession
    path = f"{store.rstrip('/')}/model-{hashlib.md5(repr((params, list(features))).encode()).hexdigest()}"
    if not _finished(spark, path):
        fit_boosted_trees(labelled, params, features).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrix_key(matrix: DataFrame) -> str:
    """A digest of a matrix: its columns, number of rows and the exclusive or of its rows' hashes."""
    names = [F.col(f"`{c}`") for c in matrix.columns]
    sums = matrix.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*names)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr((matrix.dtypes, tuple(sums))).encode()).hexdigest()
