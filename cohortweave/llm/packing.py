"""Best-fit packing of token ids into sequences, planned over a histogram of lengths.

1. Every document becomes ids plus an end id; only documents longer than a
   sequence are cut, the first piece taking what is left over.  Pieces are
   written once to the shared folder, so texts are tokenized once.
2. Pieces are counted by length: at most ``capacity`` rows reach the driver.
3. Best fit decreasing runs over these counts.  All sequences with equal room
   are one range of sequence numbers, so a step places a whole range of pieces.
   The plan's size depends on the capacity, not on the number of documents.
4. A piece takes the planned slot of its rank among the pieces of its length.
   The task that writes a piece numbers it among its own pieces of that length; the
   pieces of earlier tasks are a sum over one row per task and length.  So ids don't
   move, and a length that a third of all pieces share is ranked like any other.

Cases: a null or empty text is the end id alone; repeated rows and equal ids are
packed row by row; ids may be null; an empty table packs into nothing; other columns
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.chunks import blocks
from cohortweave.llm.common import bound_batches, pick
from cohortweave.operators.joins import lookup_join
from cohortweave.session import materialize

CAPACITY = 1024
END_ID = 2

_OUT_BYTES = 4 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, writer long, nth long"
_RANK = ["writer", "nth"]
_loaded: dict[int, tiktoken.Encoding] = {}


def byte_ranks(model: str) -> dict[bytes, int]:
    """Merge ranks of the byte-level vocabulary in a tokenizer file, which are its ids.

    Holds if ids follow the order of merges, as in byte-level vocabularies made
    by merging; anything else is refused.
    """
    body = json.loads(model)["model"]
    vocab = body["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in body["merges"]]
    if merged != sorted(merged) or len(set(merged)) != len(merged):
        raise ValueError("the tokenizer's ids don't follow the order of its merges")
    # bytes that are no visible character are written as the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ordinary = set(merged) | {vocab[c] for c in byte_of}
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i in ordinary}


def added_tokens(model: str) -> dict[str, int]:
    """Added tokens of a tokenizer file, which texts are split at, and their ids.

    Those that take white space or neighbours into account, hold white space or begin
    each other would need more than a split; they are refused.
    """
    tokens = json.loads(model).get("added_tokens") or []
    names = [t["content"] for t in tokens]
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens)
    if odd or any(len(n.split()) != 1 or n != n.strip() for n in names) or any(
        a != b and b.startswith(a) for a in names for b in names
    ):
        raise ValueError(f"added tokens {names} are more than plain strings")
    return {t["content"]: t["id"] for t in tokens}


def _encoder(model: str) -> tiktoken.Encoding:
    """The encoder of a tokenizer file's text; built once per worker process.

    It gives the ids of the tokenizers library (``add_special_tokens=False``), four times as fast: also
    there, added tokens that a text holds get their own ids.
    """
    key = zlib.crc32(model.encode())
    if key not in _loaded:
        _loaded[key] = tiktoken.Encoding(
            "packing", pat_str=PATTERN, mergeable_ranks=byte_ranks(model), special_tokens=added_tokens(model)
        )
    return _loaded[key]


def encode(encoder: tiktoken.Encoding, text: str | None) -> bytes:
    """Packed ids of a text, block by block."""
    return b"".join(
        encoder.encode_to_numpy(" " + block if spaced else block, allowed_special="all").astype("<u4").tobytes()
        for block, spaced in blocks(text or "")
    )


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n_ids`` ids."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, piece, start, length, ids_crc32, ids, writer, nth.

    ``ids`` holds little-endian unsigned 32-bit numbers; ``nth`` counts from 0 the pieces of a length that the task
    ``writer`` makes, so both hold for the rows as they are written once.  The tokenizer file is
    read by the driver and sent to the executors (a vocabulary: a few MB).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model.value)
        columns = [c.split()[0] for c in _PIECES.split(", ")]
        writer, made = TaskContext.get().partitionId(), defaultdict(int)
        held, size = [], 0
        for batch in batches:
            doc_ids = batch["doc_id"].astype(object)
            doc_ids = doc_ids.where(doc_ids.notna(), None)
            for doc_id, text in zip(doc_ids, batch["text"]):
                packed = encode(encoder, text) + end
                for number, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    ids = packed[4 * start : 4 * (start + length)]
                    held.append((doc_id, number, start, length, zlib.crc32(ids), ids, writer, made[length]))
                    made[length] += 1
                    size += len(ids) + 64
                    if size > _OUT_BYTES:
                        yield pd.DataFrame(held, columns=columns).astype({"doc_id": "Int64"})
                        held, size = [], 0
        yield pd.DataFrame(held, columns=columns).astype({"doc_id": "Int64"})

    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInPandas(pieces, _PIECES)


Slots = list[tuple[int, int, int, int, int]]


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> Slots:
    """Best fit decreasing over counts of lengths.

    Each slot range (length, first rank, number, first sequence, offset) says
    where that many pieces of this length go: to consecutive sequences, each at
    the same offset.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots: Slots = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            best = next((r for r in range(length, capacity + 1) if room[r]), None)
            if best is None:
                best = capacity
                fresh = -(-left // (capacity // length))
                room[best].append((opened, fresh))
                opened += fresh
            first, number = room[best].pop()
            used = min(number, left)
            if used < number:
                room[best].append((first + used, number - used))
            room[best - length].append((first, used))
            slots.append((length, rank, used, first, capacity - best))
            rank += used
            left -= used
    return slots


class SlotTable:
    """The plan laid out for lookup by (length, rank)."""

    def __init__(self, slots: Iterable[tuple[int, int, int, int, int]]):
        table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
        self.keys = (table[:, 0] << 44) | table[:, 1]
        self.first_rank, self.sequence, self.offset = table[:, 1], table[:, 3], table[:, 4]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) | rank, side="right") - 1
        return self.sequence[at] + rank - self.first_rank[at], self.offset[at]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` in place of ``writer`` and ``nth`` of written pieces."""
    spark = pieces.sparkSession
    earlier = Window.partitionBy("length").orderBy("writer").rowsBetween(Window.unboundedPreceding, -1)
    made = pieces.groupBy("writer", "length").agg(F.count(F.lit(1)).alias("n"))
    made = made.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # lengths are at most the capacity
    place_of = (F.col("writer") * (capacity + 1) + F.col("length")).alias("_place")
    made = materialize(made.select("*", place_of), "pieces-by-writer")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(SlotTable(plan_slots(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = table.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    kept = [c for c in pieces.columns if c not in _RANK]
    # by a broadcast if the measured size allows
    ranked = lookup_join(pieces.select("*", place_of), made.select("_place", "_before"), "_place", spread=["doc_id", "piece"])
    rank = F.col("_before") + F.col("nth")
    return ranked.select(*kept, slot("length", rank).alias("_slot")).select(*kept, "_slot.sequence_id", "_slot.offset")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its offset there.

    ``with_ids=False`` leaves the ids in the written pieces and moves only numbers.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "token-pieces")
    return place(pieces if with_ids else pieces.drop("ids"), capacity)
