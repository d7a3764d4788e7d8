"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Documents are sets of five-word shingles.  Every distinct shingle weighs the same, however often
a text repeats it: so candidates follow the similarity by which links are verified.

1. Sketch.  Each shingle is a Poisson process whose rate is its weight; each arrival
   falls on one of ``REGISTERS`` registers, and a register remembers the shingle that
   reaches it first.  Two documents agree in a register with the probability
   Jaccard of their weights, which for equal weights is the Jaccard similarity of
   their sets.  A process ends at the first arrival later than every register
   of its document, so long documents cost little more than one arrival per shingle.
   Equal texts have one class key and from here on are one class.
2. Bands.  Runs of registers are hashed; classes that share a band are candidates
   (a pair of similarity 0.8 shares one with probability 0.9999).
3. Stars.  In each band the members are paired with the least one only, compared by
   their registers, and verified by the Jaccard similarity of their shingle sets.
   Verified links give first components.
4. The rest.  Where a band still holds several components, its members are compared in
   blocks, within the task: likely pairs of different components are verified there, and
   links that join components are returned, fewer than members.  So the final components are
   those of all verified candidate pairs, though no step emits the pairs of a group.
Texts are read again once, for the classes that share a band.

Cases: a text of one to four words is one shingle; a null or blank text is in a class of its own;
repeated rows and equal ids are members like others; null ids stay and count as the greatest;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.common import SPACE_CLASS, bound_batches, digest_key, free_name, pick
from cohortweave.llm.components import connected_components
from cohortweave.operators.joins import fits_broadcast
from cohortweave.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BAND_ROWS = 5
BANDS = 25
#: Registers (of which one byte each is compared) that a pair must share to be verified:
#: five standard deviations under what a pair of similarity 0.8 shares.
LEAST_SHARED = 80
#: Members of one block where all pairs of a band are compared.
BLOCK_MEMBERS = 512
#: Measured size up to which the keys of candidates are broadcast.
BROADCAST_KEYS_BYTES = 32 << 20

_WORD = re.compile("[^\x20\x09-\x0d]+")
_GROUP_SHINGLES = 1 << 19
_STEP = 0x9E3779B97F4A7C15
_GOLDEN = np.uint64(_STEP)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of all runs of five words, in order; one of all words if they are fewer."""
    found = _WORD.findall(text or "")
    if not found:
        return np.empty(0, np.uint64)
    distinct = {w: xxhash.xxh64_intdigest(w) for w in set(found)}
    codes = np.array([distinct[w] for w in found], dtype=np.uint64)
    width = min(SHINGLE_WORDS, len(codes))
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = _mix(total + codes[i : len(codes) - width + 1 + i] + _GOLDEN)
    return total


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def sketch(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers of some documents, each given as distinct shingles and their weights."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    element = np.concatenate([s for s, _ in sets]) if n else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if n else np.empty(0)
    first = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, dtype=np.uint64)
    elapsed = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        bits = _mix(element + np.uint64(turn * _STEP % (1 << 64)))
        uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        elapsed = elapsed - np.log(uniform) / weight
        cell = owner * REGISTERS + (bits & np.uint64(REGISTERS - 1)).astype(np.int64)
        early = np.flatnonzero(elapsed < first[cell])
        # latest first: where several reach one register, the earliest is written last
        early = early[np.argsort(-elapsed[early], kind="stable")]
        first[cell[early]] = elapsed[early]
        holder[cell[early]] = element[early]
        latest = first.reshape(n, REGISTERS).max(axis=1)
        on = elapsed < latest[owner]
        owner, element, weight, elapsed = owner[on], element[on], weight[on], elapsed[on]
    return holder.reshape(n, REGISTERS)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """Hash of each band of each document."""
    total = np.tile(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(registers), 1))
    banded = registers[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
    for i in range(BAND_ROWS):
        total = _mix(total + banded[:, :, i] + _GOLDEN)
    return total.view(np.int64)


def class_key(text: Column) -> Column:
    """The same number for the same words: 120 bits of their md5; null without words."""
    joined = F.btrim(F.regexp_replace(text, SPACE_CLASS + "+", " "))
    return F.when(F.length(joined) > 0, digest_key(joined))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, bands (array of long) and registers (one byte each) of all documents."""
    bound_batches(docs.sparkSession)

    def groups(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, size = 0, 0
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            for text in batch["text"]:
                distinct = np.unique(shingles(text))
                sets.append((distinct, np.ones(len(distinct))))
                size += len(distinct)
                if size > _GROUP_SHINGLES:
                    yield batch.iloc[start : start + len(sets)], sets
                    start, size, sets = start + len(sets), 0, []
            if sets:
                yield batch.iloc[start:], sets

    def sketched(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in groups(batches):
            registers = sketch(sets)
            small = _mix(registers).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "key": rows["key"],
                    "bands": list(bands_of(registers)),
                    "registers": [r.tobytes() for r in small],
                }
            )

    keyed = docs.select("doc_id", class_key(F.col("text")).alias("key"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    # ids travel as text: pandas would turn integers beside nulls into floats
    return (
        keyed.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(sketched, "doc_id string, key decimal(38,0), bands array<long>, registers binary")
        .withColumn("doc_id", F.col("doc_id").cast(kind))
    )


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough registers."""
    a = classes.select(F.col("key").alias("a"), F.col("registers").alias("ra"))
    b = classes.select(F.col("key").alias("b"), F.col("registers").alias("rb"))

    @F.pandas_udf("boolean")
    def enough(ra: pd.Series, rb: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(ra), np.uint8).reshape(-1, REGISTERS)
        right = np.frombuffer(b"".join(rb), np.uint8).reshape(-1, REGISTERS)
        return pd.Series((left == right).sum(axis=1) >= LEAST_SHARED)

    return pairs.join(a, "a").join(b, "b").filter(enough("ra", "rb")).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text per wanted key.  The keys are broadcast if their measured size allows, else
    the texts are shuffled once."""
    if fits_broadcast(wanted, BROADCAST_KEYS_BYTES):
        wanted = F.broadcast(wanted)
    keyed = docs.select(class_key(F.col("text")).alias("key"), "text")
    return keyed.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose shingle sets have the similarity."""

    @F.pandas_udf("boolean")
    def similar(ta: pd.Series, tb: pd.Series) -> pd.Series:
        held: dict[str, np.ndarray] = {}

        def distinct(text: str) -> np.ndarray:
            # the least member of a band meets many others in turn
            if text not in held:
                if len(held) > 64:
                    held.clear()
                held[text] = np.unique(shingles(text))
            return held[text]

        return pd.Series([jaccard(distinct(x), distinct(y)) >= SIMILARITY for x, y in zip(ta, tb)], dtype=bool)

    a = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").filter(similar("ta", "tb")).select("a", "b")


def _compare_block(group: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one group (a band, or two blocks of its members) between components.

    A pair is compared in the first band that it shares, and only while the links found
    here don't join its components already; so a group returns fewer links than it has members.
    """
    n = len(group)
    registers = np.frombuffer(b"".join(group["registers"]), np.uint8).reshape(n, REGISTERS)
    bands = np.stack(group["bands"].to_numpy())
    here = int(np.flatnonzero(bands[0] == group["band"].iloc[0])[0])
    keys, texts, own = group["key"].to_numpy(), group["text"].to_numpy(), group["own"].to_numpy()
    component = pd.factorize(group["root"])[0]
    crossing = group["i"].iloc[0] != group["j"].iloc[0]
    sets: list[np.ndarray | None] = [None] * n

    def distinct(i: int) -> np.ndarray:
        if sets[i] is None:
            sets[i] = np.unique(shingles(texts[i]))
        return sets[i]

    found = []
    for x in range(n - 1):
        others = np.arange(x + 1, n)
        others = others[component[others] != component[x]]
        if crossing:
            others = others[own[others] != own[x]]
        others = others[(registers[others] == registers[x]).sum(axis=1) >= LEAST_SHARED]
        others = others[~(bands[others, :here] == bands[x, :here]).any(axis=1)]
        for y in others:
            if component[y] != component[x] and jaccard(distinct(x), distinct(y)) >= SIMILARITY:
                found.append((keys[x], keys[y]))
                component[component == component[y]] = component[x]
    return pd.DataFrame(found, columns=["a", "b"])


def _rest_links(members: DataFrame, classes: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between different components in one band, other than with its least class."""
    rooted = members.filter("n > 2 AND key <> least").select("band", "key").join(
        roots.select(F.col("node").alias("key"), "root"), "key", "left"
    )
    rooted = materialize(rooted.select("band", "key", F.coalesce("root", "key").alias("root")), "band-roots")
    mixed = (
        rooted.groupBy("band")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low <> high")
        .select("band", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    )
    mixed = materialize(mixed, "mixed-bands")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # a member meets every block of its band; two blocks are one group
    spread = (
        rooted.join(mixed, "band")
        .select("band", "key", "root", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("band", "key", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(classes, "key")
        .join(texts, "key")
    )
    return spread.groupBy("band", "i", "j").applyInPandas(_compare_block, "a decimal(38,0), b decimal(38,0)").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, ``root`` and ``class_id`` of all documents (doc_id, text).

    A root stands for a class of near duplicates; its ``class_id`` is the least id in it.
    Blank texts have neither key nor root, and their own id as class.
    """
    docs = pick(docs, "doc_id", "text")
    sketched = materialize(sketches(docs), "sketches")
    known = sketched.filter("key IS NOT NULL")
    # equal texts have equal sketches
    classes = known.groupBy("key").agg(F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    classes = materialize(classes, "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(banded.join(materialize(shared, "shared-bands"), "band"), "band-members")
    texts = materialize(_texts(docs, members.select("key").distinct()), "candidate-texts")
    stars = members.filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    links = materialize(_verified(_likely(stars, classes), texts), "star-links")
    roots = materialize(connected_components(links), "star-components")
    more = materialize(_rest_links(members, classes, texts, roots), "rest-links")
    if more.isEmpty():
        final = roots
    else:
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))
        final = materialize(connected_components(edges), "components")
    rows = sketched.select("doc_id", "key").join(final.select(F.col("node").alias("key"), "root"), "key", "left")
    rows = materialize(rows.select("doc_id", "key", F.coalesce("root", "key").alias("root")), "classed-rows")
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("_least")), "class-ids")
    return rows.join(least.filter("root IS NOT NULL"), "root", "left").select(
        "doc_id", "key", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("class_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (its columns as they are) with one row of each class: the one with the least id.

    Of rows with equal id and text one stays.  What goes is decided on ids and keys; the documents are read once
    and don't move, unless those marks are too many to broadcast.
    """
    found = materialize(near_duplicates(docs).filter("root IS NOT NULL"), "classed")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    each = found.groupBy("root", "doc_id", "key").agg(F.first(is_first).alias("is_first"), F.count(F.lit(1)).alias("n"))
    # an id may repeat with other texts: then the least key stays
    least = F.min(F.when(F.col("is_first"), F.col("key"))).over(Window.partitionBy("root", "doc_id"))
    goes = ~F.col("is_first") | (F.col("key") != least)
    marks = each.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), goes.alias("_goes"), "n")
    marks = materialize(marks.filter("_goes OR n > 1").drop("n"), "marks")
    repeats = not marks.filter("NOT _goes").isEmpty()
    if fits_broadcast(marks):
        marks = F.broadcast(marks)
    key, goes_ = free_name(docs, "class_key"), free_name(docs, "class_goes")
    keyed = docs.withColumn(key, class_key(F.col("text")))
    marks = marks.withColumnRenamed("_goes", goes_)
    marked = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks["_id"]) & (keyed[key] == marks["_key"]), "left").drop("_id", "_key")
    kept = marked.filter(F.col(goes_).isNull())
    if repeats:
        # rows whose copies have the same id
        kept = kept.unionByName(marked.filter(~F.col(goes_)).dropDuplicates([key]))
    return kept.drop(key, goes_)
