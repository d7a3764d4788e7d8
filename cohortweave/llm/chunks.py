"""Encoding texts by their distinct chunks between single spaces.

The split pattern of the byte-level vocabularies never matches across the place
before a single space that stands between two other characters that are no
white space, and looks at nothing beyond it.  Text may therefore be cut there,
each distinct chunk encoded once, and the ids joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLOCK = 1 << 20


class ChunkEncoder:
    """Token ids (little-endian unsigned 32-bit) of texts, from an encoder of chunks.

    ``encode_chunks`` gets distinct strings and returns their packed ids.  What
    is remembered is bounded by ``remembered`` chunks; texts are read in blocks.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], remembered: int = 200_000):
        self._encode = encode_chunks
        self._remembered = remembered
        self._spaced: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text in turn; null counts as empty."""
        group: list[list[tuple[str, bool]]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > _BLOCK:
                yield from self._group(group)
                group, size = [], 0
                yield b"".join(b for block in blocks(text) for b in self._group([[block]]))
                continue
            group.append([(text, False)] if text else [])
            size += len(text)
            if size > _BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[tuple[str, bool]]]) -> list[bytes]:
        split = [[(_CUT.split(block), spaced) for block, spaced in blocks] for blocks in group]
        if len(self._spaced) + len(self._bare) > self._remembered:
            self._spaced.clear()
            self._bare.clear()
        bare, spaced = set(), set()
        for blocks in split:
            for chunks, starts_spaced in blocks:
                (spaced if starts_spaced else bare).add(chunks[0])
                spaced.update(chunks[1:])
        self._learn(bare, self._bare, "")
        self._learn(spaced, self._spaced, " ")
        return [b"".join(self._ids(*block) for block in blocks) for blocks in split]

    def _learn(self, chunks: set[str], known: dict[str, bytes], before: str) -> None:
        missing = [chunk for chunk in chunks if chunk not in known]
        if missing:
            known.update(zip(missing, self._encode([before + chunk for chunk in missing])))

    def _ids(self, chunks: list[str], starts_spaced: bool) -> bytes:
        first = (self._spaced if starts_spaced else self._bare)[chunks[0]]
        spaced = self._spaced
        return first + b"".join([spaced[chunk] for chunk in chunks[1:]])


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """Blocks of a long text, cut at allowed places; whether a space stood before each."""
    start, spaced = 0, False
    while True:
        cut = _CUT.search(text, start + _BLOCK) if start + _BLOCK < len(text) else None
        yield text[start : cut.start() if cut else len(text)], spaced
        if cut is None:
            return
        start, spaced = cut.end(), True
