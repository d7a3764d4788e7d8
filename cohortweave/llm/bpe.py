"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of the split pattern that are no token themselves are grouped by
length into padded matrices of token ids.  In each round every row merges its
leftmost pair of least rank; pair ranks come from an open-addressed hash table,
rows that have no pair left leave the matrix (compaction).  A piece too long for
a padded matrix is merged alone, many equal pairs a round, with the same result:
the round stops at the first merge that creates a pair of lower rank.

Both directions run within tasks and need no shuffle.  Texts are read in blocks and
remembered chunks are bounded, so memory follows neither text nor vocabulary of words.

Cases: a null or empty text has no ids; text that cannot be UTF-8 (lone surrogates,
which Spark strings never hold) is not expected; ids outside the vocabulary fail the
decoding; repeated rows and equal ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.chunks import ChunkEncoder
from cohortweave.llm.common import bound_batches, pick

#: Rank of a pair that merges to no token.
NONE = np.iinfo(np.int32).max
#: Bytes of the longest piece that goes into a padded matrix.
MATRIX_WIDTH = 256

_MATRIX_CELLS = 1 << 18
_OUT_BYTES = 8 << 20
_DECODE_IDS = 1 << 20
_loaded: dict[tuple[int, str], tuple[PairMerger, ChunkEncoder]] = {}


class PairTable:
    """Open-addressed hash table from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._values = np.full(1 << bits, NONE, dtype=np.int32)
        keys = self._key(left, right)
        slots, waiting = self._home(keys), np.arange(len(keys))
        while len(waiting):
            free = self._keys[slots] == -1
            # of those that want the same free slot, one gets it
            self._keys[slots[free]] = keys[waiting[free]]
            placed = self._keys[slots] == keys[waiting]
            self._values[slots[placed]] = merged[waiting[placed]]
            waiting, slots = waiting[~placed], (slots[~placed] + 1) & self._mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE for pairs that don't merge or have a padded (negative) side."""
        shape = left.shape
        keys = self._key(left, right).ravel()
        out = np.full(len(keys), NONE, dtype=np.int32)
        asked = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._home(keys[asked])
        while len(asked):
            held = self._keys[slots]
            hit = held == keys[asked]
            out[asked[hit]] = self._values[slots[hit]]
            on = ~hit & (held != -1)
            asked, slots = asked[on], (slots[on] + 1) & self._mask
        return out.reshape(shape)


class PairMerger:
    """Ids of byte strings under a rank file, and their bytes again."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        left, right, merged = np.array(pairs, dtype=np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self._lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._starts = np.concatenate(([0], np.cumsum(self._lengths)))
        self._flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    @staticmethod
    def load(text: bytes) -> PairMerger:
        lines = (line.split() for line in text.splitlines() if line.strip())
        return PairMerger({base64.b64decode(token): int(rank) for token, rank in lines})

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: the piece's own token if it is one, else merged from bytes."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], dtype=np.int32)
            elif len(piece) > MATRIX_WIDTH:
                out[i] = self._merge_long(self._byte_ids[np.frombuffer(piece, dtype=np.uint8)])
            else:
                width = max(4, 1 << (len(piece) - 1).bit_length())
                buckets.setdefault(width, []).append(i)
        for width, members in buckets.items():
            step = max(1, _MATRIX_CELLS // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        ids = self._byte_ids[text].reshape(len(pieces), width)
        lengths = np.array([len(p) for p in pieces])
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        out: list[np.ndarray] = [None] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            best = ranks[each, at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for row, merged in zip(rows[done], ids[done]):
                    out[row] = merged[merged >= 0]
                ids, ranks, rows, at, best = ids[~done], ranks[~done], rows[~done], at[~done], best[~done]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = best
            ids = _without(ids, at + 1)
            ranks = _without(ranks, at)
            self._renew(ids, ranks, each, at - 1)
            self._renew(ids, ranks, each, at)
        return out

    def _renew(self, ids: np.ndarray, ranks: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Look up the ranks of the pairs that start at column ``at`` of each row."""
        there = (at >= 0) & (at < ranks.shape[1])
        rows, at = rows[there], at[there]
        ranks[rows, at] = self.pairs.rank(ids[rows, at], ids[rows, at + 1])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.copy()
        ranks = self.pairs.rank(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # overlapping pairs (a run of one token) merge every other time, from the left
            run = np.cumsum(np.concatenate(([True], np.diff(at) != 1))) - 1
            starts = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            at = at[(np.arange(len(at)) - starts[run]) % 2 == 0]
            # what stands beside each merge at its turn
            touches = np.concatenate(([False], np.diff(at) == 2))
            left = np.where(touches, best, np.where(at > 0, ids[at - 1], -1))
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            new = np.full(len(at), best, dtype=np.int32)
            lower = np.minimum(self.pairs.rank(left, new), self.pairs.rank(new, right)) < best
            if lower.any():
                at = at[: lower.argmax() + 1]
            ids[at] = best
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            moved = at - np.arange(len(at))
            changed = np.unique(np.concatenate((moved - 1, moved)))
            changed = changed[(changed >= 0) & (changed < len(ranks))]
            ranks[changed] = self.pairs.rank(ids[changed], ids[changed + 1])
        return ids

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        parts = []
        for start in range(0, len(ids), _DECODE_IDS):
            part = ids[start : start + _DECODE_IDS].astype(np.int64)
            lengths = self._lengths[part]
            ends = np.cumsum(lengths)
            from_ = np.repeat(self._starts[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            parts.append(self._flat[from_].tobytes())
        return b"".join(parts)


def _without(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``matrix`` without one given column in each row."""
    keep = np.ones(matrix.shape, dtype=bool)
    keep[np.arange(len(matrix)), columns] = False
    return matrix[keep].reshape(len(matrix), matrix.shape[1] - 1)


def load(ranks_text: bytes, pattern: str) -> tuple[PairMerger, ChunkEncoder]:
    """Merger and text encoder for a rank file's content; built once per worker process."""
    key = (zlib.crc32(ranks_text), pattern)
    if key not in _loaded:
        merger = PairMerger.load(ranks_text)
        find = regex.compile(pattern).findall

        def encode(chunks: list[str]) -> list[bytes]:
            split = [find(chunk) for chunk in chunks]
            distinct = {piece: i for i, piece in enumerate({p for pieces in split for p in pieces})}
            ids = merger.encode_pieces([piece.encode("utf-8") for piece in distinct])
            packed = [i.astype("<u4").tobytes() for i in ids]
            return [b"".join([packed[distinct[p]] for p in pieces]) for pieces in split]

        _loaded[key] = merger, ChunkEncoder(encode)
    return _loaded[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit numbers) of all documents (doc_id, text).

    The rank file is read by the driver and sent to the executors (under a MB).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load(ranks.value, pattern)[1]
        for batch in batches:
            start, size = 0, 0
            held: list[bytes] = []
            for ids in encoder.encode(batch["text"]):
                held.append(ids)
                size += len(ids)
                if size > _OUT_BYTES:
                    stop = start + len(held)
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:stop], "ids": held})
                    start, size, held = stop, 0, []
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:], "ids": held})

    narrow = pick(docs, "doc_id", "text")
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        encoded, "doc_id string, ids binary"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    spark = encoded.sparkSession
    bound_batches(spark)
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("binary")
    def decoded(packed: pd.Series) -> pd.Series:
        merger = load(ranks.value, pattern)[0]
        return pd.Series([None if p is None else merger.decode(p) for p in packed], dtype=object)

    return encoded.select(*encoded.columns, decoded(ids).alias(to))
