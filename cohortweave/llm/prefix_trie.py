"""A Z-fast trie over the turns of conversations, built and expanded as Spark tables.

A conversation is a string of turns (role, text); a node of the trie is a prefix that some conversation
starts with.  Only branching prefixes and whole conversations are stored (compacted nodes); the
turns between a node and its parent are the node's edge.

1. Texts shrink to digests at once.  A prefix is named by its length and 128 bits: the exclusive or of
   hashes of its turns with their places, a running aggregate per conversation.  Equal conversations are
   one line from here on.
2. Handles.  A node whose edge covers the depths (a, b] is stored under its prefix of the two-fattest
   depth there: the number in (a, b] that the highest power of two divides.
3. Fat binary search.  Each line narrows the depths (l, r] where it leaves the trie: it looks up its
   prefix of the two-fattest depth in (l, r]; a hit moves ``l`` to the end of the node found (or ends in
   that node's edge), a miss moves ``r`` below.  So a line of n turns asks for log2(n) + 1 prefixes; a round
   is two joins of one row per line, and no shared prefix is read again.
4. Insertion in batches, each larger than the ones before.  Behind the node where a line leaves the trie
   its turns are new, or lie on one edge; the rows of these turns and of the edges that are left
   meet in one grouping (with partial sums before its shuffle), whose branching and final prefixes are
   the new nodes.  An edge that was cut gets its new parent and handle.
5. Sums below a node come from its lines: every line visits the nodes on its way, and everything that
   belongs to one node only is carried by the line that represents it.
6. Expansion.  Every edge becomes its nodes of one turn each, joined to the turns of the edge's line.

Cases: rows are ordered by turn, nulls first, rows of equal turn by a digest of role and text; a null
role or text is empty; rows without a conversation id belong to no conversation; repeated
rows are further turns; conversations without turns are members of the root alone; an empty table
gives an empty result; other columns, also with clashing names, are ignored.  Texts of any length count
by digest and number of words.  Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.common import pick, words
from cohortweave.session import materialize

#: Shares of all lines that lie in the trie after each batch.
BATCHES = (1 / 32, 1.0)
#: Turns taken from another conversation in the registered query, and ids that share one.
MOST_SHARED, SHARED_IDS = 3, 20
#: Ids of a block of members have all but this many low bits in common.
MEMBER_BITS = 12
#: Turns of an edge that are numbered at a time.
EDGE_BLOCK = 1 << 16

_PREFIX = ["depth", "p", "q"]
_NODE = [*_PREFIX, "above", "ap", "aq", "rep", "handle", "hp", "hq", "fp", "fq"]


def fattest(above: Column, depth: Column) -> Column:
    """The two-fattest number in (above, depth]: ``depth`` without the bits below the highest one
    in which both differ."""
    differ = above.bitwiseXOR(depth)
    top = F.length(F.bin(differ)) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", depth, top), top)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and number of words of every turn."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    narrow = rows.select(
        F.col("conv_id").cast("long"),
        "turn",
        F.unhex(F.md5(told.cast("binary"))).alias("digest"),
        F.size(words(text)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    return narrow.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "words")


def rebuild(places: DataFrame) -> DataFrame:
    """The conversations of the registered query, from ``turns``; ``place`` is null where one has no turns.

    Each begins with up to three turns of the first conversation of its twenty in place of its own.
    """
    places = materialize(places, "trie-originals")
    ids = places.filter("place = 1").select("conv_id")
    ids = ids.withColumn("shared", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1))
    ids = ids.withColumn("origin", F.col("conv_id") - F.col("conv_id") % SHARED_IDS)
    heads = places.filter(F.col("place") <= MOST_SHARED).withColumnRenamed("conv_id", "origin")
    held = heads.groupBy("origin").agg(F.count(F.lit(1)).alias("held"))
    taken = (
        ids.join(heads, "origin").filter("place <= shared").select("conv_id", "place", "digest", "words")
    )
    begun = ids.join(held, "origin", "left").select(
        "conv_id", "shared", F.least("shared", F.coalesce("held", F.lit(0))).alias("begun")
    )
    own = (
        places.join(begun, "conv_id")
        .filter("place > shared")
        .select("conv_id", (F.col("place") - F.col("shared") + F.col("begun")).alias("place"), "digest", "words")
    )
    filled = taken.unionByName(own)
    empty = ids.join(filled.select("conv_id").distinct(), "conv_id", "left_anti")
    return filled.unionByName(empty.select("conv_id"), allowMissingColumns=True)


def prefixes(places: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, p, q, those of the next turn, and words.

    ``before`` counts the words ahead of the prefix's last turn.
    """
    along = Window.partitionBy("conv_id").orderBy("place")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = places.filter("place IS NOT NULL").select(
        "conv_id",
        F.col("place").alias("depth"),
        F.bit_xor(F.xxhash64(F.lit(1), "place", "digest")).over(so_far).alias("p"),
        F.bit_xor(F.xxhash64(F.lit(2), "digest", "place")).over(so_far).alias("q"),
        (F.sum("words").over(so_far) - F.col("words")).alias("before"),
        "words",
    )
    after = Window.partitionBy("conv_id").orderBy("depth")
    return named.withColumns({"next_p": F.lead("p").over(after), "next_q": F.lead("q").over(after)})


def _at(lines: DataFrame, line: str, depth: str, *names: str) -> DataFrame:
    """Prefixes of lines, with the columns ``line``, ``depth`` and the names of p and q there."""
    return lines.select(
        F.col("conv_id").alias(line), F.col("depth").alias(depth), F.col("p").alias(names[0]), F.col("q").alias(names[1])
    )


def locate(lines: DataFrame, ends: DataFrame, trie: DataFrame | None) -> DataFrame:
    """Where lines leave the trie: conv_id, and ``l``, ``lp``, ``lq`` of their deepest stored prefix.

    ``lines`` are prefixes, ``ends`` the last ones of the lines to be located; no trie is an empty one.
    """
    zero = F.lit(0).cast("long")
    state = ends.select(
        "conv_id", zero.alias("l"), zero.alias("lp"), zero.alias("lq"), F.col("depth").alias("r")
    )
    if trie is None:
        return state.drop("r")
    longest = ends.agg(F.max("depth")).first()[0] or 0
    nodes = trie.select(
        F.col("handle").alias("f"), F.col("hp").alias("fp"), F.col("hq").alias("fq"), F.col("depth").alias("end"),
        F.col("p").alias("ep"), F.col("q").alias("eq"), "above", "ap", "aq",
    )
    for level in reversed(range(longest.bit_length())):
        state = state.withColumn("f", F.expr(f"shiftleft(shiftright(r, {level}), {level})"))
        asks = state.filter("f > l")
        found = (
            # only these depths are asked for at this level
            asks.join(_at(lines.filter(F.col("depth") % (1 << level) == 0), "conv_id", "f", "fp", "fq"), ["conv_id", "f"])
            .join(nodes, ["f", "fp", "fq"], "left")
            .join(_at(lines, "conv_id", "end", "xp", "xq"), ["conv_id", "end"], "left")
        )
        hit = F.col("end").isNotNull()
        through = hit & F.coalesce((F.col("xp") == F.col("ep")) & (F.col("xq") == F.col("eq")), F.lit(False))

        def moved(passed: str, inside: str, kept: str) -> Column:
            return F.when(through, F.col(passed)).when(hit, F.col(inside)).otherwise(F.col(kept))

        below = F.when(through, F.col("r")).when(hit, F.col("above")).otherwise(F.col("f") - 1)
        found = found.select(
            "conv_id", moved("end", "above", "l").alias("l"), moved("ep", "ap", "lp").alias("lp"),
            moved("eq", "aq", "lq").alias("lq"), below.alias("r"),
        )
        state = materialize(found.unionByName(state.filter("f <= l").drop("f")), "trie-search")
    return state.drop("r")


def edge_turns(nodes: DataFrame) -> DataFrame:
    """Every depth ``at`` of the edges (above, depth] of some nodes, numbered a block at a time."""
    first, last = F.col("above") + 1, F.col("depth")
    blocks = F.sequence(F.floor(first / EDGE_BLOCK), F.floor(last / EDGE_BLOCK))
    begin = F.greatest(first, F.col("_block") * EDGE_BLOCK)
    end = F.least(last, (F.col("_block") + 1) * EDGE_BLOCK - 1)
    return nodes.withColumn("_block", F.explode(blocks)).withColumn("at", F.explode(F.sequence(begin, end))).drop("_block")


def _cut_edges(lines: DataFrame, new: DataFrame, trie: DataFrame) -> DataFrame:
    """The turns of the stored edges on which ``new`` turns begin, like those."""
    leaving = new.filter("depth = base + 1").select(
        F.col("base").alias("above"), F.col("p").alias("fp"), F.col("q").alias("fq")
    )
    cut = trie.join(leaving.distinct(), ["above", "fp", "fq"], "left_semi")
    each = edge_turns(cut.select("rep", "above", "ap", "aq", "depth")).select(
        F.col("rep").alias("conv_id"), "at", F.col("above").alias("base"), F.col("ap").alias("bp"),
        F.col("aq").alias("bq"), (F.col("at") == F.col("depth")).alias("last"),
    )
    return each.join(lines.withColumnRenamed("depth", "at"), ["conv_id", "at"]).withColumnRenamed("at", "depth")


def insert(lines: DataFrame, batch: DataFrame, trie: DataFrame | None) -> DataFrame:
    """The trie with some more lines; ``batch`` holds their last prefixes."""
    left = locate(lines, batch, trie)
    # the base of a stretch of new turns is the stored prefix above it
    base = left.select("conv_id", F.col("l").alias("base"), F.col("lp").alias("bp"), F.col("lq").alias("bq"))
    new = lines.join(base, "conv_id").filter("depth > base").withColumn("last", F.lit(False))
    if trie is not None:
        new = materialize(new, "trie-new")
        new = new.unionByName(_cut_edges(lines, new, trie))
    fresh = materialize(new, "trie-fresh")
    branching = (F.min("next_p") != F.max("next_p")) | (F.min("next_q") != F.max("next_q"))
    ending = F.max(F.col("next_p").isNull() | F.col("last"))
    marks = (
        fresh.groupBy(*_PREFIX)
        .agg(F.min("conv_id").alias("rep"), (F.coalesce(branching, F.lit(False)) | ending).alias("is_node"))
        .filter("is_node")
        .drop("is_node")
    )
    marks = materialize(marks, "trie-marks")
    along = Window.partitionBy("conv_id", "base").orderBy("depth")

    def parent(of: str, base_: str) -> Column:
        return F.coalesce(F.lag(of).over(along), F.col(base_))

    placed = (
        fresh.join(marks, _PREFIX)
        .select(*_PREFIX, "rep", "conv_id", parent("depth", "base").alias("above"), parent("p", "bp").alias("ap"),
                parent("q", "bq").alias("aq"))
        # the line that represents a node knows its parent like every other
        .filter("conv_id = rep")
        .drop("conv_id")
        .withColumns({"handle": fattest(F.col("above"), F.col("depth")), "begin": F.col("above") + 1})
    )
    placed = placed.join(_at(lines, "rep", "handle", "hp", "hq"), ["rep", "handle"]).join(
        _at(lines, "rep", "begin", "fp", "fq"), ["rep", "begin"]
    )
    grown = placed.select(*_NODE)
    if trie is not None:
        grown = grown.unionByName(trie.join(marks.select(*_PREFIX), _PREFIX, "left_anti").select(*_NODE))
    return materialize(grown, "trie")


def build(lines: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """The Z-fast trie of all lines: every compacted node but the root, with its parent (above, ap, aq),
    the line that represents it, its handle and the first prefix of its edge (fp, fq)."""
    trie = None
    ends = lines.filter("next_p IS NULL").withColumn("_draw", F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)))
    low = 0
    for share in batches:
        high = int(share * (1 << 20))
        trie = insert(lines, ends.filter(F.col("_draw").between(low, high - 1)).drop("_draw"), trie)
        low = high
    return trie


def _members(last: DataFrame) -> DataFrame:
    """Digest of the ids of all conversations that end at a prefix, in ascending order.

    Ids are sorted and joined in blocks of neighbouring numbers; one task reads a prefix's blocks in order.
    """
    block = F.shiftright("conv_id", MEMBER_BITS)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = last.groupBy(*_PREFIX, block.alias("block")).agg(joined.alias("ids"))
    sorted_ = blocks.repartition(*_PREFIX).sortWithinPartitions(*_PREFIX, "block")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        done = []
        for batch in batches:
            for depth, p, q, ids in zip(*[batch[c].tolist() for c in (*_PREFIX, "ids")]):
                if (depth, p, q) != current:
                    if current is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = (depth, p, q), hashlib.sha256(ids.encode())
                else:
                    digest.update(("," + ids).encode())
            if done:
                yield pd.DataFrame(done, columns=[*_PREFIX, "ends_sha256"])
                done = []
        if current is not None:
            done.append((*current, digest.hexdigest()))
        yield pd.DataFrame(done, columns=[*_PREFIX, "ends_sha256"])

    return sorted_.select(*_PREFIX, "ids").mapInPandas(digests, "depth long, p long, q long, ends_sha256 string")


def nodes(places: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """Every node of the trie of conversations (conv_id, place, digest, words), see ``turns``.

    A row with null ``place`` says that a conversation has no turns.  Returns conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    places = materialize(places, "trie-turns")
    everyone = materialize(prefixes(places), "trie-prefixes")
    last = everyone.filter("next_p IS NULL").select("conv_id", *_PREFIX, (F.col("before") + F.col("words")).alias("total"))
    empty = places.filter("place IS NULL").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _PREFIX])
    # equal conversations are one line, named by their least id
    classes = last.groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    classes = materialize(classes, "trie-classes")
    lines = materialize(everyone.join(classes.select("conv_id"), "conv_id", "left_semi"), "trie-lines")
    trie = build(lines, batches)
    children = trie.groupBy(
        F.col("above").alias("depth"), F.col("ap").alias("p"), F.col("aq").alias("q")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    children = materialize(children, "trie-children")
    leaf = F.col("n_children").isNull().cast("long").alias("leaf")
    sized = classes.join(children, _PREFIX, "left").select("conv_id", "n", "total", leaf)
    way = lines.select("conv_id", *_PREFIX, (F.col("before") + F.col("words")).alias("words"))
    way = way.join(trie.select(*_PREFIX, "rep"), _PREFIX)
    way = materialize(way.join(sized, "conv_id"), "trie-ways")
    along = Window.partitionBy("conv_id").orderBy("depth")
    own = F.when(F.col("rep") == F.col("conv_id"), F.col("edge")).otherwise(0)
    way = way.withColumn("edge", F.col("words") - F.coalesce(F.lag("words").over(along), F.lit(0)))
    way = way.withColumn("own", own).withColumn(
        # words of the line's own edges below the node
        "below",
        F.sum("own").over(Window.partitionBy("conv_id"))
        - F.sum("own").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    sums = way.groupBy(*_PREFIX).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        (F.sum(F.col("n") * (F.col("total") - F.col("words"))) - F.sum("below")).alias("saved"),
        F.max(F.when(F.col("rep") == F.col("conv_id"), F.col("words"))).alias("reach"),
        F.max(F.when(F.col("rep") == F.col("conv_id"), F.col("edge"))).alias("edge"),
    )
    sums = materialize(sums, "trie-sums")
    ends = materialize(_members(last.select("conv_id", *_PREFIX).unionByName(empty)), "trie-ends")
    root = _root(places, sums, children, classes, ends)
    return root.unionByName(_expanded(lines, trie, sums, children, ends, root))


def _closed(n_children: Column) -> Column:
    return F.coalesce(n_children, F.lit(0)).cast("long")


_NONE = hashlib.sha256(b"").hexdigest()


def _root(places: DataFrame, sums: DataFrame, children: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """The root's row, from seven sums; none where there is no conversation."""
    least, n_convs = places.agg(F.min("conv_id"), F.countDistinct("conv_id")).first()
    told = classes.agg(F.sum(F.col("n") * F.col("total"))).first()[0] or 0
    stored = sums.agg(F.sum("edge")).first()[0] or 0
    leaves = classes.join(children, _PREFIX, "left_anti").count()
    top = children.filter("depth = 0").agg(F.sum("n_children")).first()[0] or 0
    mine = ends.filter("depth = 0").agg(F.max("ends_sha256")).first()[0]
    rows = [(least, 0, None, n_convs, top, max(leaves, 1), told - stored, mine or _NONE)] if n_convs else []
    return places.sparkSession.createDataFrame(
        rows,
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string",
    )


def _expanded(
    lines: DataFrame, trie: DataFrame, sums: DataFrame, children: DataFrame, ends: DataFrame, root: DataFrame
) -> DataFrame:
    """All nodes but the root: the edges of the compacted ones turn by turn."""
    zero = F.lit(0).cast("long")
    parents = sums.select(*_PREFIX, "conv_id").unionByName(root.select("depth", zero.alias("p"), zero.alias("q"), "conv_id"))
    parents = parents.select(
        F.col("depth").alias("above"), F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("conv_id").alias("over")
    )
    full = (
        trie.select(*_PREFIX, "above", "ap", "aq", "rep")
        .join(sums, _PREFIX)
        .join(children, _PREFIX, "left")
        .join(ends, _PREFIX, "left")
        .join(parents, ["above", "ap", "aq"], "left")
    )
    full = materialize(full, "trie-nodes")
    here = lines.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), "before")
    each = edge_turns(full).join(here, ["rep", "at"])
    inner = F.col("at") < F.col("depth")
    return each.select(
        "conv_id",
        F.col("at").alias("depth"),
        F.when(F.col("at") > F.col("above") + 1, F.col("conv_id")).otherwise(F.col("over")).alias("parent_conv_id"),
        "n_convs",
        F.when(inner, F.lit(1).cast("long")).otherwise(_closed(F.col("n_children"))).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("reach") - F.col("before"))).cast("long").alias("saved_tokens"),
        F.when(inner, F.lit(_NONE)).otherwise(F.coalesce("ends_sha256", F.lit(_NONE))).alias("ends_sha256"),
    )
