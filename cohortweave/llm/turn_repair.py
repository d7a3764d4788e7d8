"""Repair of the turn structure of conversations, streamed through sorted partitions.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an
assistant turn.  Every row is kept (K, 0), given the other role (R, 2) or deleted (D, 3; the only
choice for blank rows and for copies of an earlier row); turns without text may be inserted anywhere
(I, 2); a truncated row that stays costs 1 more.  The cheapest edits are taken, of equally cheap
ones those whose letters come first in ASCII order.

1. Rows are dealt by conversation and sorted there by role and text (a window marks copies of earlier
   rows), then by turn: one shuffle, two external sorts.
2. ``mapInPandas`` reads the rows in order.  What the dynamic programme has to carry from row to row,
   also across Arrow batches, is small: which of the four states (nothing yet, after the system turn,
   after a user turn, after an assistant turn) may still lie on the best way, by how much each costs
   more than the cheapest, and the order of the letters that lead there.  Ways that cost so much
   more that another state can imitate their future are dropped, so few such situations exist; a step
   from one by a kind of row is worked out once and remembered under a number.
3. The number of its step is the backpointer of a row.  Steps and rows of the open conversation wait
   in a journal, which goes to a scratch file of the task beyond ``JOURNAL_BYTES``.  At the
   conversation's end the steps are followed backwards, then its rows are read once more, forwards.

So a task holds a batch, a bounded journal and the letters of one conversation (one byte a row, part of
the result), however long a conversation is.  A conversation isn't split among tasks, as its digest
runs over all its repaired turns; a lost executor's partitions are computed again from the shuffle.

Cases: a null role or text is empty, and an empty role cannot be kept; null conversation ids are one conversation; null turns come
first; rows of equal turn are taken by role, then text; repeated rows are copies of each other; blank
texts must go; texts of any length are hashed as they stream; an empty table gives an empty result;
other columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.common import SPACE_CHARS, SPACE_CLASS, bound_batches, pick

#: Bytes of rows and steps of one conversation that wait in memory.
JOURNAL_BYTES = 32 << 20

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RETYPE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Faults as they are coded; deleted rows of ``GONE`` only say that their conversation exists.
SOUND, TRUNCATED, BLANK, DUPLICATE, GONE = range(5)
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Letters that end a conversation from each state.
_ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: What a way through the row's state costs more at most than the best one through the column's:
#: it can imitate every future of that state for this much.
_IMITATE = (
    (0, 0, 2, 4),
    (4, 0, 2, 4),
    (5, 2, 0, 2),
    (3, 0, 2, 0),
)

SUMMARY = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)
TURNS = "conv_id string, place long, edit string, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """The damage of the registered query: conv_id, turn, role, text and ``live`` (false: row dropped)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = rows.withColumns({"_draw": draw, "role": filled("role"), "text": filled("text")})
    text = (
        F.when(F.col("_draw") == 1, F.lit(""))
        .when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("_draw") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_draw") != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    ).drop("_copy")


def with_faults(rows: DataFrame, live: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ``initial`` (0 s, 1 u, 2 a, 3 other) and the first ``fault`` of every row.

    Rows come dealt by conversation and sorted by turn within their partition.
    """
    named = pick(rows, "conv_id", "turn", "role", "text", *([live] if live else []))
    held = named.toDF("conv_id", "turn", "role", "text", *(["_live"] if live else []))
    if not live:
        held = held.withColumn("_live", F.lit(True))
    held = held.select(
        "conv_id", "turn", "_live", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    dealt = held.withColumn("_digest", digest).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "_live", "_digest").orderBy("turn")
    first = F.substring("role", 1, 1)
    initial = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        initial = F.when(first == letter, i).otherwise(initial)
    last = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    fault = (
        F.when(~F.col("_live"), GONE)
        .when(~F.col("text").rlike("[^" + SPACE_CLASS[1:]), BLANK)
        .when(F.col("_nth") > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    return (
        dealt.withColumn("_nth", F.row_number().over(earlier))
        .select("conv_id", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


#: A situation: the states still in play in the order of the letters that lead to them, each with
#: its cost above the cheapest.
Situation = tuple[tuple[int, int], ...]
START: Situation = ((NOTHING, 0),)


def _moves(state: int, initial: int, fault: int) -> Iterator[tuple[str, int, int]]:
    """(letters, next state, cost) of the ways over one row.  Insertions before a deletion, or two
    before a row, are never the cheapest and first in order."""
    yield DELETE, state, DELETE_COST
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    if state == NOTHING and initial == 0:
        yield KEEP, SYSTEM, extra
    for inserted in (0, 1):
        due = ASSISTANT if (state == USER) != bool(inserted) else USER
        cost = extra + inserted * INSERT_COST
        if initial == due - 1:
            yield INSERT * inserted + KEEP, due, cost
        yield INSERT * inserted + REROLE, due, cost + RETYPE_COST


class Steps:
    """Steps from situation to situation, worked out once and numbered."""

    def __init__(self) -> None:
        self._known: dict[tuple[Situation, int, int], tuple[int, Situation, int]] = {}
        #: for every number: state reached -> (state left, letters)
        self.back: list[dict[int, tuple[int, str]]] = []

    def step(self, at: Situation, initial: int, fault: int) -> tuple[int, Situation, int]:
        """(number, next situation, cost that all its ways have in common)."""
        key = (at, initial, fault)
        if key not in self._known:
            self._known[key] = self._work_out(at, initial, fault)
        return self._known[key]

    def _work_out(self, at: Situation, initial: int, fault: int) -> tuple[int, Situation, int]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for order, (state, cost) in enumerate(at):
            for letters, target, more in _moves(state, initial, fault):
                way = (cost + more, order, letters, state)
                if target not in best or way < best[target]:
                    best[target] = way
        in_play = [
            s for s in best if not any(best[o][0] + _IMITATE[o][s] < best[s][0] for o in best if o != s)
        ]
        common = min(best[s][0] for s in in_play)
        in_play.sort(key=lambda s: best[s][1:3])
        self.back.append({s: (best[s][3], best[s][2]) for s in in_play})
        return len(self.back) - 1, tuple((s, best[s][0] - common) for s in in_play), common


class Journal:
    """Steps and rows of one conversation; beyond a bound they lie in a scratch file."""

    def __init__(self, limit: int) -> None:
        self._limit = limit
        self._steps, self._rows, self._size = array("I"), [], 0
        self._file = None
        #: where each written part begins, where its steps end
        self._parts: list[tuple[int, int]] = []

    def add(self, step: int, role: str, text: str) -> None:
        self._steps.append(step)
        self._rows.append((role, text))
        self._size += 4 * (len(role) + len(text)) + 64
        if self._size > self._limit:
            self._spill()

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        begin = self._file.seek(0, 2)
        self._file.write(self._steps.tobytes())
        self._parts.append((begin, self._file.tell()))
        pickle.dump(self._rows, self._file)
        self._steps, self._rows, self._size = array("I"), [], 0

    def steps_backwards(self) -> Iterator[int]:
        yield from reversed(self._steps)
        for begin, end in reversed(self._parts):
            self._file.seek(begin)
            steps = array("I")
            steps.frombytes(self._file.read(end - begin))
            yield from reversed(steps)

    def rows(self) -> Iterator[tuple[str, str]]:
        for _, end in self._parts:
            self._file.seek(end)
            yield from pickle.load(self._file)
        yield from self._rows

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class Conversation:
    """What is carried from row to row of the open conversation."""

    def __init__(self, conv_id: str | None, steps: Steps, limit: int) -> None:
        self.conv_id = conv_id
        self._steps = steps
        self._journal = Journal(limit)
        self._at, self._cost = START, 0
        self._counts = [0] * 5
        self._illegal = 0
        self._before: int | None = None
        self._first_turn = self._last_turn = None
        self._turns = 0

    def add(self, turn: str | None, role: str, text: str, initial: int, fault: int) -> None:
        if fault == GONE:
            return
        if turn is not None and turn != self._last_turn:
            self._turns += 1
            self._last_turn = turn
            if self._first_turn is None:
                self._first_turn = turn
        self._counts[fault] += 1
        if self._before is not None and (self._before, initial) not in LEGAL:
            self._illegal += 1
        self._before = initial
        number, self._at, more = self._steps.step(self._at, initial, fault)
        self._cost += more
        self._journal.add(number, role, text)

    def _edits(self) -> tuple[int, str]:
        """(cost, letters) of the best way."""
        cost, _, letters, state = min(
            (cost + INSERT_COST * len(_ENDING[state]), order, _ENDING[state], state)
            for order, (state, cost) in enumerate(self._at)
        )
        parts = [letters]
        for number in self._journal.steps_backwards():
            state, letters = self._steps.back[number][state]
            parts.append(letters)
        parts.reverse()
        return self._cost + cost, "".join(parts)

    def finish(self) -> Iterator[tuple]:
        """The repaired turns (edit, role, text; role None: deleted), then the summary."""
        cost, audit = self._edits()
        digest, empty = hashlib.sha256(), True
        rows, state = self._journal.rows(), NOTHING
        for edit in audit:
            role, text = ("", "") if edit == INSERT else next(rows)
            if edit == DELETE:
                yield edit, None, None
                continue
            if edit == KEEP and state == NOTHING and role[:1] == INITIALS[0]:
                state = SYSTEM
            else:
                state = ASSISTANT if state == USER else USER
                role = role if edit == KEEP else _ROLE_OF[state]
            digest.update((("" if empty else "\n") + role + ":" + text).encode())
            empty = False
            yield edit, role, text
        self._journal.close()
        gaps = int(self._last_turn) - int(self._first_turn) + 1 - self._turns if self._turns else 0
        yield (
            self.conv_id, gaps, self._counts[BLANK], self._counts[DUPLICATE], self._counts[TRUNCATED],
            self._illegal, cost, audit, digest.hexdigest(),
        )


def _conversations(batches: Iterable[pd.DataFrame], limit: int) -> Iterator[Conversation]:
    """Every conversation of a sorted partition, when all its rows were read."""
    steps, current = Steps(), None
    for batch in batches:
        columns = [batch[c].tolist() for c in ("conv_id", "turn", "role", "text", "initial", "fault")]
        for conv_id, turn, role, text, initial, fault in zip(*columns):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    yield current
                current = Conversation(conv_id, steps, limit)
            current.add(turn, role, text, initial, fault)
    if current is not None:
        yield current


def _streamed(rows: DataFrame, live: str | None) -> DataFrame:
    bound_batches(rows.sparkSession)
    # ids and turns travel as text: pandas would turn integers beside nulls into floats
    faults = with_faults(rows, live)
    return faults.select(
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "initial", "fault"
    )


def repair(rows: DataFrame, live: str | None = None, journal_bytes: int = JOURNAL_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): its faults and edits.

    ``gaps`` counts the missing turn numbers; ``blank``, ``duplicate`` and ``truncated`` the first
    faults of rows; ``illegal`` the neighbours out of turn; ``cost`` and ``audit`` tell the edits;
    ``repaired_sha256`` is the digest of the repaired ``role:text`` lines.  ``live`` names a boolean column;
    rows where it is false don't count, but their conversation has a row.
    """

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        held, size = [], 0
        for conversation in _conversations(batches, journal_bytes):
            for row in conversation.finish():
                pass
            held.append(row)
            size += len(row[-2]) + 200
            if size > 4 << 20:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    kind = dict(pick(rows, "conv_id").dtypes)["conv_id"]
    return _streamed(rows, live).mapInPandas(summaries, SUMMARY).withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_turns(rows: DataFrame, live: str | None = None, journal_bytes: int = JOURNAL_BYTES) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TURNS.split(", ")]
        held, size = [], 0
        for conversation in _conversations(batches, journal_bytes):
            place = 0
            for row in conversation.finish():
                if len(row) != 3 or row[1] is None:
                    continue
                held.append((conversation.conv_id, place, *row))
                place += 1
                size += 4 * len(row[2]) + 100
                if size > 4 << 20:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    kind = dict(pick(rows, "conv_id").dtypes)["conv_id"]
    return _streamed(rows, live).mapInPandas(turns, TURNS).withColumn("conv_id", F.col("conv_id").cast(kind))
