"""An n-gram trie in Elias-Fano coded levels that are read from a memory-mapped file.

A level holds the last ids of all its nodes, in the order of their contexts.  Ids (1 or more) become
one increasing sequence by adding, within each context, the last value of the context before; pointers
(the first child of every node) increase anyway.  Both are cut into blocks of ``BLOCK`` numbers,
each stored as Elias and Fano proposed: low bits as they are, high bits in unary.

A child is found relative to its context: the value before the context's first child is added to
the id, and the successor of that sum in the level, if equal and still among the context's children, is
the node.  Queries come sorted, so that each block is decoded at most once per batch.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

BLOCK = 4096


def _encoded(values: np.ndarray) -> tuple[int, int, bytes]:
    """Width of the low bits, bytes of the low part, and both parts of increasing offsets from 0."""
    width = max(0, int(values[-1]) // len(values)).bit_length()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(len(values))
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return width, len(low), low + np.packbits(high, bitorder="little").tobytes()


class Sequence:
    """A nondecreasing sequence of 64-bit numbers, coded block by block in a mapped buffer."""

    def __init__(self, buffer: np.ndarray, n: int, first: np.ndarray, width: np.ndarray, low: np.ndarray, at: np.ndarray):
        self._buffer, self._n = buffer, n
        self._first, self._width, self._low, self._at = first, width, low, at

    def __len__(self) -> int:
        return self._n

    @staticmethod
    def write(values: np.ndarray, file: io.BufferedIOBase) -> dict[str, np.ndarray | int]:
        """Append the blocks of ``values`` to a file; returns what the constructor needs besides."""
        values = values.astype(np.uint64)
        firsts, widths, lows, places = [], [], [], [file.tell()]
        for start in range(0, len(values), BLOCK):
            part = values[start : start + BLOCK]
            width, low, data = _encoded(part - part[0])
            file.write(data)
            firsts.append(part[0])
            widths.append(width)
            lows.append(low)
            places.append(file.tell())
        return {
            "n": len(values),
            "first": np.array(firsts, np.uint64),
            "width": np.array(widths, np.int64),
            "low": np.array(lows, np.int64),
            "at": np.array(places, np.int64),
        }

    def block(self, i: int) -> np.ndarray:
        """The decoded numbers of a block."""
        n = min(BLOCK, self._n - i * BLOCK)
        begin, middle, end = self._at[i], self._at[i] + self._low[i], self._at[i + 1]
        ones = np.flatnonzero(np.unpackbits(self._buffer[middle:end], bitorder="little"))
        width = int(self._width[i])
        values = (ones - np.arange(n)).astype(np.uint64) << np.uint64(width)
        if 0 < width <= 56:
            # each low part lies within the eight bytes from its first one on
            low = np.append(self._buffer[begin:middle], np.zeros(8, np.uint8))
            bit = np.arange(n, dtype=np.int64) * width
            eight = np.ndarray((middle - begin + 1,), "<u8", low, strides=(1,))[bit >> 3]
            values += (eight >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)
        elif width:
            values += _wide(np.unpackbits(self._buffer[begin:middle], count=n * width, bitorder="little").reshape(n, width))
        return values + self._first[i]

    def _blocks(self, wanted: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each block among the ascending block numbers ``wanted``, with its stretch."""
        edges = np.flatnonzero(np.diff(wanted)) + 1
        starts = [0, *edges.tolist()] if len(wanted) else []
        for begin, end in zip(starts, [*edges.tolist(), len(wanted)]):
            yield int(wanted[begin]), slice(begin, end)

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The numbers at ascending positions."""
        found = np.empty(len(positions), np.uint64)
        for i, part in self._blocks(positions // BLOCK):
            found[part] = self.block(i)[positions[part] - i * BLOCK]
        return found

    def spans(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ascending positions and those after them."""
        here, after = np.empty(len(positions), np.uint64), np.empty(len(positions), np.uint64)
        for i, part in self._blocks(positions // BLOCK):
            numbers = self.block(i)
            if i + 1 < len(self._first):
                numbers = np.append(numbers, self._first[i + 1])
            inside = positions[part] - i * BLOCK
            here[part], after[part] = numbers[inside], numbers[inside + 1]
        return here, after

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and value of the first number that is no less, for ascending values.

        A position equal to the length, with value 0, means that there is none.
        """
        positions = np.full(len(values), self._n, np.int64)
        found = np.zeros(len(values), np.uint64)
        if not self._n:
            return positions, found
        # the block that begins at or before the value; its successor may be the next block's first
        holder = np.maximum(np.searchsorted(self._first, values, side="left") - 1, 0)
        for i, part in self._blocks(holder):
            numbers = self.block(i)
            inside = np.searchsorted(numbers, values[part], side="left")
            positions[part] = i * BLOCK + inside
            here = inside < len(numbers)
            found[part] = np.where(here, numbers[np.minimum(inside, len(numbers) - 1)], 0)
            if i + 1 < len(self._first):
                found[part] = np.where(here, found[part], self._first[i + 1])
        return positions, found


def _wide(bits: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bits), np.uint64)
    for i in range(bits.shape[1]):
        total |= bits[:, i].astype(np.uint64) << np.uint64(i)
    return total


class Trie:
    """Distinct n-grams of one order with two numbers each: a code of a byte and a count."""

    def __init__(self, file: io.BufferedIOBase, parts: dict):
        file.flush()
        size = file.seek(0, 2)
        self._buffer = np.memmap(file, np.uint8, "r", shape=(size,)) if size else np.empty(0, np.uint8)
        self.order: int = parts["order"]
        self._ids = [Sequence(self._buffer, **p) for p in parts["ids"]]
        self._children = [Sequence(self._buffer, **p) for p in parts["children"]]
        begin, end = parts["codes"]
        self.codes = self._buffer[begin:end]
        begin, end = parts["counts"]
        self.counts = self._buffer[begin:end].view(parts["count_type"])

    @classmethod
    def build(cls, grams: np.ndarray, codes: np.ndarray, counts: np.ndarray, file: io.BufferedIOBase) -> Trie:
        """A trie of ascending distinct rows of ids (1 or more) written to an empty file."""
        n, order = grams.shape
        parts: dict = {"order": order, "ids": [], "children": []}
        starts = np.zeros(n, bool)
        node_of_row = np.zeros(n, np.int64)
        for level in range(order):
            # a node starts where any of the first ids changes
            changed = np.ones(n, bool)
            changed[1:] = grams[1:, level] != grams[:-1, level]
            starts = starts | changed
            at = np.flatnonzero(starts)
            ids = grams[at, level].astype(np.uint64)
            if level:
                parent = node_of_row[at]
                first = np.ones(len(at), bool)
                first[1:] = parent[1:] != parent[:-1]
                begins = np.flatnonzero(first)
                # the last id of a context is added to all that follow
                last = np.concatenate([ids[begins[1:] - 1], ids[-1:]]) if len(begins) else ids[:0]
                offset = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]])
                ids = ids + (np.repeat(offset, np.diff(np.append(begins, len(at)))) if len(begins) else ids)
                parts["children"].append(Sequence.write(np.append(begins, len(at)), file))
            parts["ids"].append(Sequence.write(ids, file))
            node_of_row = np.cumsum(starts) - 1
        begin = file.tell()
        file.write(codes.astype(np.uint8).tobytes())
        parts["codes"] = (begin, file.tell())
        file.write(b"\0" * (-file.tell() % 8))
        kind = np.dtype("<u4") if not n or counts.max() < 1 << 32 else np.dtype("<u8")
        begin = file.tell()
        file.write(counts.astype(kind).tobytes())
        parts["counts"], parts["count_type"] = (begin, file.tell()), kind
        return cls(file, parts)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Number of each n-gram, -1 if absent; rows ascending."""
        n = len(grams)
        node = np.full(n, -1, np.int64)
        rows = np.arange(n)
        if not n or not len(self._ids[0]):
            return node
        wanted = grams[:, 0].astype(np.uint64)
        positions, values = self._ids[0].successor(wanted)
        keep = (positions < len(self._ids[0])) & (values == wanted)
        rows, positions = rows[keep], positions[keep]
        for level in range(1, self.order):
            ids = self._ids[level]
            begin, end = (p.astype(np.int64) for p in self._children[level - 1].spans(positions))
            offset = np.zeros(len(rows), np.uint64)
            inner = begin > 0
            offset[inner] = ids.access(begin[inner] - 1)
            wanted = grams[rows, level].astype(np.uint64) + offset
            positions, values = ids.successor(wanted)
            keep = (positions < end) & (values == wanted)
            rows, positions = rows[keep], positions[keep]
        node[rows] = positions
        return node
