"""Second-order boosted trees as Spark aggregates, with the model as a table of nodes.

Features are cut into quantile bins once.  A level of a tree is one job: each task sums the gradients and
hessians of the weighted logistic loss of its rows by node, feature and bin that is not the lowest bin (numpy
over Arrow batches), the sums of a node meet in one task and are added there; the lowest bin is what
remains of the node.  Every sum from the highest bin downwards is a candidate split, scored by its
gain in the penalised second-order loss.

Several settings are fitted side by side: one job serves a level of all of them.  A row is held once, with its
running score (``margin``) under every setting; trees that are not yet in the stored scores travel with the job and are
walked there.  The exact rank AUC of the held-out rows decides when a fit ends; it is counted for several
rounds at once, at the latest in the first round in which a fit could end.

Gradients are summed as whole multiples of 2^-30.  So sums don't depend on the order of rows, and a task
that runs again after an executor was lost gives the same tree.

What reaches the driver is the model itself: its nodes, which depth and number of trees bound, and one AUC
per fit and round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortweave.operators.joins import fits_broadcast
from cohortweave.session import materialize

MAX_BINS = 256
LEARNING_RATE = 0.3
PATIENCE = 10
#: Fractions of a unit in which gradients are summed.
UNITS = 1 << 30
#: Consecutive ranges of scores in which held-out rows are ranked.
SCORE_RANGES = 4096
LEAST_GAIN = 1e-6
#: Rows times trees of all fits that are walked at each use before the scores are written.
WAITING_ROWS = 5_000_000
#: Rows of a task when the rows are dealt out.
TASK_ROWS = 500_000
#: Numbers of rounds within the key of a fit and round.
ROUNDS = 1 << 20

NODES = (
    "fit int, tree int, node long, feature int, bin int, threshold double, gain double, cover double, "
    "value double, is_leaf boolean"
)


@dataclass(frozen=True)
class TreeParams:
    """One setting of the boosting: penalties act on the loss of the whole tree, as usual for
    second-order boosting."""

    max_depth: int = 5
    gamma: float = 0.0
    reg_alpha: int = 0
    reg_lambda: float = 0.0
    colsample_bytree: float = 1.0
    min_child_weight: int = 1
    scale_pos_weight: int = 4
    n_estimators: int = 180
    seed: int = 0


@dataclass
class Fit:
    """Progress of one setting: its trees, and the best round so far."""

    number: int
    params: TreeParams
    nodes: list[tuple] = field(default_factory=list)
    rounds: int = 0
    best_round: int = 0
    best_auc: float | None = None
    #: counts (tn, fp, fn, tp) of the held-out rows in the best round
    confusion: tuple[int, int, int, int] | None = None
    open: bool = True
    #: the last tree added nothing, and none of any features could
    settled: bool = False

    def ended(self, held_out: dict | None, patience: int) -> None:
        """Take note of a finished round and its held-out AUC and counts (None: nothing is held out)."""
        self.rounds += 1
        auc = held_out["auc"] if held_out else None
        if auc is None:
            self.best_round = self.rounds
        elif self.best_auc is None or auc > self.best_auc:
            self.best_round, self.best_auc = self.rounds, auc
        if held_out and self.best_round == self.rounds:
            tp, fp = held_out["tp"], held_out["fp"]
            self.confusion = (held_out["neg"] - fp, fp, held_out["pos"] - tp, tp)
        self.open = (
            self.rounds < self.params.n_estimators and self.rounds - self.best_round < patience and not self.settled
        )

    def kept_nodes(self) -> list[tuple]:
        """Nodes of the trees up to the best round."""
        return [n for n in self.nodes if n[1] < self.best_round]


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan, where a list of rows would be a job of its own."""
    declared = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [[] for _ in declared]
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, to_arrow_schema(declared))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=to_arrow_schema(declared)), declared)


def bin_edges(rows: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Upper edges of all bins but the highest of each feature: its quantiles, in one pass.

    Features of few values have a bin for each of them, but for values rarer than a quantile.
    """
    if not features:
        return []
    steps = [i / (max_bins - 1) for i in range(max_bins)]
    found = rows.agg(
        *[
            F.percentile_approx(F.col(f"`{c}`").cast("double"), steps, 100 * max_bins).alias(f"f{i}")
            for i, c in enumerate(features)
        ]
    ).first()
    return [sorted(set(values or []))[:-1] for values in found]


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below a value; nulls are in the lowest bin."""
    if not edges:
        return F.lit(0)
    if len(edges) == 1:
        return F.when(value > edges[0], 1).otherwise(0)
    below = F.aggregate(
        F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda n, e: n + F.when(value > e, 1).otherwise(0)
    )
    return F.when(value.isNull(), 0).otherwise(below)


def binned(rows: DataFrame, features: Sequence[str], edges: list[list[float]], *kept: str) -> DataFrame:
    """The columns ``kept`` and ``bins`` (one per feature)."""
    bins = [_bin(F.col(f"`{c}`").cast("double"), e).cast("int") for c, e in zip(features, edges)]
    return rows.select(*kept, F.array(*bins).cast("array<int>").alias("bins"))


def drawn_features(params: TreeParams, tree: int, n_features: int) -> list[int]:
    """The features a tree may use: those that come first by a hash of seed, tree and feature."""
    n = max(1, int(params.colsample_bytree * n_features))

    def place(feature: int) -> str:
        return hashlib.md5(f"{params.seed}:{tree}:{feature}".encode()).hexdigest()

    return sorted(sorted(range(n_features), key=place)[:n])


@dataclass
class Tree:
    """A growing tree by places: 0 is the root, the right child follows the left one, leaves lead to themselves."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    #: numbers of the nodes: children of node n are 2 n and 2 n + 1
    node: list[int] = field(default_factory=lambda: [1])
    alive: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def split(self, place: int, feature: int, bin_: int) -> int:
        """The place of the left child of a place that splits."""
        at = len(self.left)
        self.feature[place], self.bin[place], self.left[place] = feature, bin_, at
        for side in (0, 1):
            self.feature.append(0)
            self.bin.append(0)
            self.left.append(at + side - 1)
            self.value.append(0.0)
            self.node.append(2 * self.node[place] + side)
        return at

    def packed(self) -> tuple:
        slot = np.full(len(self.left), -1, np.int64)
        slot[self.alive] = np.arange(len(self.alive))
        return (
            np.array(self.feature, np.int32), np.array(self.bin, np.uint8), np.array(self.left, np.int32),
            np.array(self.value), slot, self.depth if len(self.left) > 1 else 0,
        )


@dataclass
class Held:
    """A batch of rows in a task: labels, bins (a row each) and stored scores (a column per fit)."""

    label: np.ndarray
    bins: np.ndarray
    margins: np.ndarray

    def places(self, tree: tuple) -> np.ndarray:
        """Where every row is in a packed tree."""
        feature, bin_, left, _, _, depth = tree
        at = np.zeros(len(self.label), np.int32)
        flat = self.bins.reshape(-1)
        start = np.arange(len(at), dtype=np.int32) * np.int32(self.bins.shape[1])
        for _ in range(depth):
            at = left[at] + (flat[start + feature[at]] >= bin_[at])
        return at


def _content(column: pa.Array, dtype: type) -> np.ndarray:
    """The bytes of a binary column, one after the other."""
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype)
    at = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(dtype)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of an array."""
    width = rows.shape[1] * rows.itemsize
    data, ends = np.ascontiguousarray(rows), np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _held(batch: pa.RecordBatch, n_features: int) -> Held:
    n = batch.num_rows
    bins = _content(batch.column("bins"), np.uint8).reshape(n, n_features)
    margins = _content(batch.column("margins"), np.float64).reshape(n, -1 if n else 0)
    return Held(batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64), bins, margins)


def _margin(held: Held, stored: int, waiting: Sequence[tuple]) -> Iterator[np.ndarray]:
    """The scores of a fit as stored and after every waiting tree."""
    margin = held.margins[:, stored] if held.margins.shape[1] else np.zeros(len(held.label))
    yield margin
    for tree in waiting:
        margin = margin + tree[3][held.places(tree)]
        yield margin


def gradients(margin: np.ndarray, label: np.ndarray, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole units of a row's weighted logistic loss: the size of the gradient (positive for label 0) and the hessian."""
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-margin))
    weight = np.where(label == 1, pos_weight, 1.0)
    return np.rint(weight * np.abs(p - label) * UNITS), np.rint(weight * p * (1 - p) * UNITS)


@dataclass
class Cells:
    """Where the sums of a node lie: cell 0 is the whole node, then all bins but the lowest of each feature."""

    sizes: list[int]

    def __post_init__(self):
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        self.first = ends - sizes + 1
        self.width = 1 + int(sizes.sum())
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        #: of every cell but the first: the cell after its feature's last one
        self.end = np.repeat(ends, sizes)

    def bin(self, cell: int) -> int:
        """The bin of a cell, counted without cell 0."""
        return int(cell - self.first[self.feature[cell]] + 2)


SUMS = "fit int, place int, sums binary"


def partial_sums(cells: Cells, fits: Sequence[tuple]) -> Callable:
    """A task's sums by fit and living node: gradients of label 0 and of label 1, hessians, rows; by cell.

    ``fits`` have number, weight of label 1, column of stored scores, waiting trees, the growing tree, its living places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(f[5]), 4, cells.width), np.int64) for f in fits]
        for batch in batches:
            held = _held(batch, len(cells.sizes))
            row, feature = np.nonzero(held.bins)
            cell = cells.first[feature] + held.bins[row, feature] - 1
            for (_, pos_weight, stored, waiting, tree, alive), total in zip(fits, totals):
                *_, margin = _margin(held, stored, waiting)
                g, h = gradients(margin, held.label, pos_weight)
                slot = tree[4][held.places(tree)]
                base = np.where(slot >= 0, 2 * cells.width * slot + held.label, -1)
                code, at = base[row] + 2 * cell, row
                live = base >= 0
                if not live.all():
                    kept = live[row]
                    code, at = code[kept], at[kept]
                own = np.flatnonzero(live)
                code, at = np.concatenate([code, base[own]]), np.concatenate([at, own])
                # sums of a batch are whole numbers below 2^53
                size = 2 * cells.width * len(alive)
                by_label = np.bincount(code, g[at], size).reshape(len(alive), cells.width, 2)
                total[:, 0] += by_label[:, :, 0].astype(np.int64)
                total[:, 1] += by_label[:, :, 1].astype(np.int64)
                total[:, 2] += np.bincount(code, h[at], size).reshape(len(alive), cells.width, 2).sum(2).astype(np.int64)
                total[:, 3] += np.bincount(code, minlength=size).reshape(len(alive), cells.width, 2).sum(2)
        for fit, total in zip(fits, totals):
            for start in range(0, len(total), 256):
                seen = start + np.flatnonzero(total[start : start + 256, 3, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(seen), fit[0]), pa.int32()), pa.array(np.array(fit[5])[seen], pa.int32()),
                        _binary(total[seen].reshape(len(seen), 4 * cells.width)),
                    ],
                    names=["fit", "place", "sums"],
                )

    return run


SPLITS = (
    "fit int, place int, against long, towards long, hessian long, feature int, bin int, gain double, "
    "any_gain boolean, right_against long, right_towards long, right_hessian long"
)


def best_splits(cells: Cells, settings: dict[int, tuple[TreeParams, list[int]]]) -> Callable:
    """Every node's sums (units) and its best split, if one is worth it.

    Rows in ``bin`` of ``feature`` and above go right.  The split of the greatest gain is taken, then that of the
    first feature, then of the lowest bin, among the features a fit has drawn; ``any_gain`` says whether any feature
    has a split.  ``settings`` give parameters and drawn features by fit.
    """

    def part(g: np.ndarray, h: np.ndarray, p: TreeParams) -> np.ndarray:
        """What the best value of a leaf takes from the penalised loss, twice."""
        weight = h / UNITS + p.reg_lambda
        size = np.maximum(np.abs(g / UNITS) - p.reg_alpha, 0.0) ** 2
        return np.where(weight > 0, size / np.where(weight > 0, weight, 1.0), 0.0)

    def splits(fit: int, places: list[int], sums: np.ndarray) -> Iterator[tuple]:
        params, drawn = settings[fit]
        upwards = np.zeros_like(sums)
        upwards[:, :, :-1] = np.cumsum(sums[:, :, :0:-1], axis=2)[:, :, ::-1]
        right = upwards[:, :, :-1] - upwards[:, :, cells.end]
        whole = sums[:, :, :1]
        left = whole - right
        gain = (
            part(left[:, 0] - left[:, 1], left[:, 2], params) + part(right[:, 0] - right[:, 1], right[:, 2], params)
            - part(whole[:, 0] - whole[:, 1], whole[:, 2], params)
        )
        least = params.min_child_weight * UNITS
        possible = (sums[:, 3, 1:] > 0) & (left[:, 3] > 0) & (left[:, 2] >= least) & (right[:, 2] >= least)
        worth = possible & (gain > max(params.gamma, LEAST_GAIN))
        # a billionth of a gain is a tie: the sums are exact, their quotients aren't
        order = np.where(worth & np.isin(cells.feature, drawn), np.round(gain, 9), -np.inf)
        for i, place in enumerate(places):
            at = int(order[i].argmax()) if order.shape[1] else -1
            row = (fit, place, *(int(v) for v in whole[i, :3, 0]))
            if at < 0 or order[i, at] == -np.inf:
                yield (*row, None, None, None, bool(worth[i].any()), 0, 0, 0)
            else:
                sides = (int(v) for v in right[i, :3, at])
                yield (*row, int(cells.feature[at]), cells.bin(at), float(gain[i, at]), True, *sides)

    schema = to_arrow_schema(T.StructType.fromDDL(SPLITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            sums = _content(batch.column("sums"), np.int64).reshape(-1, 4, cells.width)
            for fit, place, part_ in zip(batch.column("fit").to_pylist(), batch.column("place").to_pylist(), sums):
                found = nodes.setdefault(fit, {})
                found[place] = found[place] + part_ if place in found else part_
        for fit, found in nodes.items():
            places = list(found)
            for start in range(0, len(places), 256):
                some = places[start : start + 256]
                rows = list(splits(fit, some, np.stack([found[p] for p in some])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def leaf_value(g: float, h: float, params: TreeParams) -> float:
    """The best value of a leaf, before it is shrunk by the learning rate."""
    weight = h + params.reg_lambda
    return -math.copysign(max(abs(g) - params.reg_alpha, 0.0), g) / weight if weight > 0 else 0.0


class Boosting:
    """Fits of several settings over the same binned rows.

    ``rows`` have the columns person_id, label, is_holdout and bins; ``settings`` go by number.
    """

    def __init__(self, rows: DataFrame, edges: list[list[float]], settings: dict[int, TreeParams]):
        self.spark: SparkSession = rows.sparkSession
        self.edges = edges
        self.cells = Cells([len(e) for e in edges])
        self.fits = [Fit(number, p) for number, p in settings.items()]
        self.tasks = self.spark.sparkContext.defaultParallelism
        n, held_out = rows.agg(F.count(F.lit(1)), F.max("is_holdout")).first()
        self._n, self._holds_out = n, bool(held_out)
        self._stored: dict[int, int] = {f.number: 0 for f in self.fits}
        #: trees not yet in the stored scores, by fit
        self._waiting: dict[int, list[tuple]] = {f.number: [] for f in self.fits}

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = b.column("bins").flatten().to_numpy().astype(np.uint8).reshape(b.num_rows, -1 if b.num_rows else 0)
                empty = np.zeros((b.num_rows, 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("label"), b.column("is_holdout"), _binary(bins), _binary(empty)],
                    names=["label", "is_holdout", "bins", "margins"],
                )

        dealt = rows.repartition(max(self.tasks, -(-n // TASK_ROWS)), "person_id")
        self._state = materialize(
            dealt.select("label", "is_holdout", "bins").mapInArrow(
                packed, "label int, is_holdout boolean, bins binary, margins binary"
            ),
            "margins",
        )

    def _splits(self, fits: list[Fit], trees: dict[int, Tree], tree: int) -> list:
        """The next level of every fit that has living nodes."""
        work = [
            (f.number, float(f.params.scale_pos_weight), self._stored[f.number], list(self._waiting[f.number]),
             trees[f.number].packed(), list(trees[f.number].alive))
            for f in fits
        ]
        settings = {f.number: (f.params, drawn_features(f.params, tree, len(self.edges))) for f in fits}
        nodes = sum(len(w[5]) for w in work)
        sums = self._state.filter("NOT is_holdout").select("label", "bins", "margins").mapInArrow(
            partial_sums(self.cells, work), SUMS
        )
        met = sums.repartition(min(self.tasks, nodes), "fit", "place")
        return met.mapInArrow(best_splits(self.cells, settings), SPLITS).collect()

    def _grow(self, fits: list[Fit], tree: int) -> None:
        """One tree for every fit, which then waits; records all nodes.

        A child that can't be split is a leaf at once, by its parent's sums: at the last level, without the
        hessian of two children, or where neither label's gradients exceed the absolute penalty.
        """
        by_number = {f.number: f for f in fits}
        trees = {f.number: Tree() for f in fits}

        def leaf(fit: Fit, grown: Tree, place: int, g: float, h: float) -> float:
            value = leaf_value(g, h, fit.params)
            grown.value[place] = LEARNING_RATE * value
            fit.nodes.append(
                (fit.number, tree, grown.node[place], None, None, None, None, h, LEARNING_RATE * value, True)
            )
            return value

        while growing := [f for f in fits if trees[f.number].alive]:
            found = self._splits(growing, trees, tree)
            at_root = trees[growing[0].number].depth == 0
            for f in growing:
                trees[f.number].alive = []
                trees[f.number].depth += 1
            for r in sorted(found, key=lambda r: (r["fit"], r["place"])):
                fit, grown, place = by_number[r["fit"]], trees[r["fit"]], r["place"]
                sums = r["against"], r["towards"], r["hessian"]
                g, h = (sums[0] - sums[1]) / UNITS, sums[2] / UNITS
                if r["feature"] is None:
                    value = leaf(fit, grown, place, g, h)
                    if at_root:
                        fit.settled = value == 0 and not r["any_gain"]
                    continue
                threshold = self.edges[r["feature"]][r["bin"] - 1]
                value = LEARNING_RATE * leaf_value(g, h, fit.params)
                fit.nodes.append(
                    (fit.number, tree, grown.node[place], r["feature"], r["bin"], threshold, r["gain"], h, value, False)
                )
                left = grown.split(place, r["feature"], r["bin"])
                right = r["right_against"], r["right_towards"], r["right_hessian"]
                for side, (against, towards, hessian) in enumerate((tuple(a - b for a, b in zip(sums, right)), right)):
                    whole = (
                        grown.depth >= fit.params.max_depth
                        or max(against, towards) <= fit.params.reg_alpha * UNITS
                        or hessian < 2 * fit.params.min_child_weight * UNITS
                    )
                    if whole:
                        leaf(fit, grown, left + side, (against - towards) / UNITS, hessian / UNITS)
                    else:
                        grown.alive.append(left + side)
        for f in fits:
            self._waiting[f.number].append(trees[f.number].packed())

    def _held_out(self, fits: list[Fit], tree: int) -> dict[tuple[int, int], dict]:
        """Rank AUC and counts of the held-out rows of every fit in each round that has none yet."""
        work = [
            (f.number, tree - len(self._waiting[f.number]), f.rounds, self._stored[f.number], list(self._waiting[f.number]))
            for f in fits
        ]
        n_features = len(self.edges)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, margins = [], {}
            for batch in batches:
                held = _held(batch, n_features)
                labels.append(held.label)
                for number, before, known, stored, waiting in work:
                    for round_, margin in enumerate(_margin(held, stored, waiting), before):
                        if round_ > known:
                            margins.setdefault(number * ROUNDS + round_, []).append(margin)
            for key, parts in margins.items():
                values, at = np.unique(np.concatenate(parts), return_inverse=True)
                n = np.bincount(2 * at + np.concatenate(labels), minlength=2 * len(values)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), key)), pa.array(values), pa.array(n[:, 1]), pa.array(n[:, 0])],
                    names=["fit_round", "_score", "pos", "neg"],
                )

        held = self._state.filter("is_holdout").select("label", "bins", "margins")
        counts = held.mapInArrow(counted, "fit_round long, _score double, pos long, neg long")
        rows = auc_of_counts(counts, "fit_round").collect()
        return {divmod(r["fit_round"], ROUNDS): r.asDict() for r in rows}

    def _write_scores(self, fits: list[Fit]) -> None:
        """Add the waiting trees to the stored scores of the fits; those of others are dropped."""
        work = [(self._stored[f.number], list(self._waiting[f.number])) for f in fits]
        n_features = len(self.edges)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = _held(batch, n_features)
                last = [list(_margin(held, *w))[-1] for w in work]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("label", "is_holdout", "bins")] + [_binary(np.column_stack(last))],
                    names=["label", "is_holdout", "bins", "margins"],
                )

        self._state = materialize(self._state.mapInArrow(added, self._state.schema), "margins")
        self._stored = {f.number: i for i, f in enumerate(fits)}
        self._waiting = {f.number: [] for f in fits}

    def run(self, patience: int = PATIENCE) -> list[Fit]:
        """Boost until every fit has its trees, or no better AUC in ``patience`` rounds."""
        tree = 0
        while opened := [f for f in self.fits if f.open]:
            self._grow(opened, tree)
            tree += 1
            due = any(
                f.settled
                or tree >= f.params.n_estimators
                # the first round is always the best so far
                or (self._holds_out and tree - max(f.best_round, 1) >= patience)
                for f in opened
            )
            full = self._n * sum(len(self._waiting[f.number]) for f in opened) >= WAITING_ROWS
            if due or full:
                held_out = self._held_out(opened, tree) if self._holds_out else {}
                for fit in opened:
                    for round_ in range(fit.rounds + 1, tree + 1):
                        fit.ended(held_out.get((fit.number, round_)), patience)
            if full and (still := [f for f in opened if f.open]):
                self._write_scores(still)
        return self.fits


def grouped_auc(rows: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """Exact rank AUC of a score (any real number) per group, ties counted half, and counts.

    Returns ``by``, ``auc`` (null without both classes), ``pos`` and ``neg`` rows, and how many of
    them, ``tp`` and ``fp``, score above 0.

    Equal scores merge before anything is ordered; ranks are counted within ranges of the score and
    added up, so no task sees a whole group.
    """
    single = rows.select(
        by, F.col(score).alias("_score"),
        (F.col(label) == 1).cast("long").alias("pos"), (F.col(label) == 0).cast("long").alias("neg"),
    )
    return auc_of_counts(single, by)


def auc_of_counts(rows: DataFrame, by: str) -> DataFrame:
    """``grouped_auc`` of rows that count ``pos`` and ``neg`` rows of a ``_score``."""
    counts = rows.groupBy(by, "_score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    place = F.floor(F.lit(float(SCORE_RANGES)) / (1 + F.exp(-F.col("_score")))).cast("int")
    group = [by, "_range"]
    lower = Window.partitionBy(*group).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    guessed = F.col("_score") > 0
    inside = (
        counts.withColumn("_range", place)
        .withColumn("_below", below)
        .groupBy(*group)
        .agg(
            # twice the pairs within the range that the score ranks rightly
            F.sum(F.col("pos") * (2 * F.col("_below") + F.col("neg"))).alias("pairs"),
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
            F.sum(F.when(guessed, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(guessed, F.col("neg")).otherwise(0)).alias("fp"),
        )
    )
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranged = inside.withColumn("_under", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    pairs = F.sum(F.col("pairs") + 2 * F.col("pos") * F.col("_under")).cast("double")
    pos, neg = F.sum("pos"), F.sum("neg")
    auc = F.when((pos > 0) & (neg > 0), pairs / (2.0 * pos.cast("double") * neg.cast("double")))
    return ranged.groupBy(by).agg(
        auc.alias("auc"), pos.alias("pos"), neg.alias("neg"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp")
    )


def model_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """The nodes of the kept trees: the model, to be written like any table."""
    return local_frame(spark, fit.kept_nodes(), NODES).drop("fit")


def walk(rows: DataFrame, nodes: DataFrame, features: Sequence[str], key: str = "person_id") -> DataFrame:
    """``key`` and ``margin``: the sum of the leaf values that a row reaches in all trees of a model table.

    A row goes right where its feature is above the threshold; nulls go left.  Every row is walked
    down all trees side by side, one level per join; the table is broadcast if its measured size
    allows.
    """
    trees = nodes.agg(F.max("tree"), F.max("node")).first()
    if trees[0] is None:
        return rows.select(key, F.lit(0.0).alias("margin"))
    held = rows.select(
        key,
        F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("_x"),
        F.explode(F.sequence(F.lit(0), F.lit(trees[0]))).alias("tree"),
        F.lit(1).cast("long").alias("node"),
    )
    inner = nodes.filter("NOT is_leaf").select("tree", "node", "feature", "threshold")
    leaves = nodes.filter("is_leaf").select("tree", "node", "value")
    if fits_broadcast(nodes):
        inner, leaves = F.broadcast(inner), F.broadcast(leaves)
    for _ in range(int(trees[1]).bit_length() - 1):
        right = F.coalesce(F.element_at("_x", F.col("feature") + 1) > F.col("threshold"), F.lit(False)).cast("long")
        node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + right)
        held = held.join(inner, ["tree", "node"], "left").withColumn("node", node).drop("feature", "threshold")
    # summed as whole units, so that the order of trees doesn't matter
    units = F.round(F.col("value") * F.lit(float(UNITS))).cast("long")
    return held.join(leaves, ["tree", "node"]).groupBy(key).agg((F.sum(units) / F.lit(float(UNITS))).alias("margin"))


def scores(rows: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Probability of the positive class and its rounding, with the person."""
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return walk(rows, nodes, features).select(
        "person_id", probability.alias("predictions"), F.round(probability).cast("int").alias("predicted_class")
    )


def importance(nodes: DataFrame, features: Sequence[str], top: int = 100) -> DataFrame:
    """Mean gain, number of splits and mean cover of the ``top`` features by gain, ties by name."""
    names = local_frame(nodes.sparkSession, list(enumerate(features)), "feature int, name string")
    used = nodes.filter("NOT is_leaf").groupBy("feature").agg(
        F.avg("gain").alias("gain"), F.count(F.lit(1)).cast("int").alias("weight"), F.avg("cover").alias("cover")
    )
    named = used.join(F.broadcast(names), "feature").select(F.col("name").alias("feature"), "gain", "weight", "cover")
    return named.orderBy(F.col("gain").desc(), "feature").limit(top)

