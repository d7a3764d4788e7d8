"""Near-equal vectors by counting collisions of one-dimensional projections.

Vectors of one label are projected on many random directions.  For each query vector and
direction, the others whose sorted projections lie in a window centred on the query's
collide with it.  Near vectors collide in most directions, others in few: pairs whose
collisions reach a count calibrated to the wanted recall are verified by their cosine.

Equal vectors are one class first, so copies cost nothing.  The classes of a label are dealt
by a hash into tiles of at most about ``TILE`` classes, and every two tiles of a label
meet in one task, so a label of any share of the rows is spread over (tiles^2)/2 tasks of
bounded size.  A task returns one row per class with links, not its pairs: how many vectors
the class is linked with there, and a representative of its component in the task.  The work per
label grows with the square of its distinct vectors (one collision count of ``DIRECTIONS``
windows a pair); what is shuffled, with that square over ``TILE``.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and those
without label, link with nothing; vectors of unequal length don't link; repeated rows and
equal ids are vectors of their own; null ids count as the greatest; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import digest_key, pick
from cohortweave.llm.components import connected_components
from cohortweave.session import materialize

COSINE = 0.93
DIRECTIONS = 28
#: Recall of the count for a pair exactly at the threshold; nearer pairs have more.
RECALL = 0.9999
TILE = 2048
SEED = 20240229

_CELLS = 1 << 18


def window(cosine: float = COSINE) -> float:
    """Half width of the collision window: the distance of unit vectors at the threshold."""
    return math.sqrt(2 - 2 * cosine)


def calibrated_count(directions: int = DIRECTIONS, recall: float = RECALL) -> int:
    """The most collisions that a pair at the threshold reaches with the recall.

    Such a pair's projections differ by a normal variable whose deviation is the
    window, so each direction collides with the chance of one deviation.
    """
    p = math.erf(1 / math.sqrt(2))
    below = 0.0
    for count in range(directions + 1):
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > 1 - recall:
            return count
    return directions


def directions_for(size: int, directions: int = DIRECTIONS) -> np.ndarray:
    """The same random directions everywhere for vectors of one length."""
    return np.random.Generator(np.random.PCG64([SEED, size])).standard_normal((size, directions))


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """Number of directions in which each other lies in each query's window."""
    n, m = len(queries), len(others)
    counts = np.zeros(n * m, dtype=np.int64)
    for d in range(queries.shape[1]):
        order = np.argsort(others[:, d], kind="stable")
        line = others[order, d]
        low = np.searchsorted(line, queries[:, d] - half, side="left")
        width = np.searchsorted(line, queries[:, d] + half, side="right") - low
        ends = np.cumsum(width)
        place = np.arange(ends[-1] if n else 0) + np.repeat(low - (ends - width), width)
        counts += np.bincount(np.repeat(np.arange(n) * m, width) + order[place], minlength=n * m)
    return counts.reshape(n, m)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def links_within(vectors: np.ndarray, own: np.ndarray, crossing: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a tile, or between two tiles (``own`` says which tile a row is of)."""
    units = unit(vectors)
    projected = units @ directions_for(units.shape[1])
    least, half = calibrated_count(), window(cosine)
    if crossing:
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    else:
        left = right = np.arange(len(units))
    found_left, found_right = [], []
    step = max(1, _CELLS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        a, b = np.nonzero(collisions(projected[part], projected[right], half) >= least)
        a, b = part[a], right[b]
        if not crossing:
            a, b = a[a < b], b[a < b]
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            near = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
            found_left.append(x[near])
            found_right.append(y[near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_left]), np.concatenate([none, *found_right])


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least row that each of n rows reaches over the pairs."""
    root = np.arange(n)
    while True:
        lower = root.copy()
        np.minimum.at(lower, left, root[right])
        np.minimum.at(lower, right, root[left])
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    found = label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(found, F.lit(False))


def linked(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of all vectors (vec_id, embedding, label)."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    key = digest_key(F.concat_ws(":", F.col("label").cast("string"), F.array_join("embedding", ",")))
    rows = rows.withColumn("key", F.when(usable(F.col("embedding"), F.col("label")), key))
    classes = (
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("label").alias("label"),
            F.first("embedding").cast("array<double>").alias("vector"),
        )
        .withColumn("size", F.size("vector"))
    )
    classes = materialize(classes, "vector-classes")
    tiles = classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiles = materialize(tiles, "label-tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = (
        classes.join(tiles, ["label", "size"])
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
        .withColumn("other", other)
        .select(
            "label", "size", "key", "n", "vector", "own",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(group["vector"].to_numpy()).astype(np.float64)
        own, keys, n = group["own"].to_numpy(), group["key"].to_numpy(), group["n"].to_numpy()
        crossing = bool(group["i"].iloc[0] != group["j"].iloc[0])
        if crossing and len(np.unique(own)) < 2:
            return pd.DataFrame({"key": [], "n_links": [], "root": []})
        left, right = links_within(data, own, crossing, cosine)
        total = np.bincount(left, n[right], len(n)) + np.bincount(right, n[left], len(n))
        root = local_roots(len(n), left, right)
        on = np.flatnonzero(total > 0)
        return pd.DataFrame({"key": keys[on], "n_links": total[on].astype(np.int64), "root": keys[root[on]]})

    found = spread.groupBy("label", "size", "i", "j").applyInPandas(
        compare, "key decimal(38,0), n_links long, root decimal(38,0)"
    )
    found = materialize(found, "tile-links")
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    of_class = (
        classes.select("key", "n")
        .join(counts, "key", "left")
        .join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
        .select(
            "key",
            (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "key").alias("root"),
        )
    )
    of_class = materialize(of_class, "class-links")
    members = materialize(rows.select("vec_id", "key").join(of_class, "key", "left"), "vector-members")
    least = materialize(
        members.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("_least")), "component-ids"
    )
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("_least"))
    return members.join(least, "root", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
