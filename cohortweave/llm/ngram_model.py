"""Scores of texts under an n-gram model whose counts lie in Elias-Fano coded tries.

The model is a Dirichlet-smoothed backoff: P(w | context) = (c(context w) + m P(w | shorter context)) /
(c(context) + m), down to the smoothed frequency of the word.  It is learned from all training documents,
with nothing pruned, and grows with them, so it is held in shards that no task sees as a whole.

1. Blocks.  Texts become blocks of at most ``BLOCK_TOKENS`` tokens of numbered words, written once, in
   buckets of their number.  Longer texts continue in the next block, with the words they need for context.
2. Requests.  A block sends each of its distinct words, then each of its distinct n-grams of two and more
   words, with its count in training texts, to the shard that a hash of the whole n-gram names.  So a
   frequent word, pair or context is spread over all shards, and arrives once per block, however often
   it occurs.
3. Shards.  A shard of words adds counts and numbers the words.  A shard of n-grams adds counts, divides them
   by the smoothed counts of their contexts (which the requests bring), quantises the logarithms to one byte
   and builds the trie of ``elias_fano.py`` in a mapped scratch file.  It answers all requests by searching it.
4. Answers return to their blocks, bucketed like them, so that later joins move nothing; the blocks ask for the next order and in the end add up the logarithms.

Shards, blocks and answers hold bounded numbers of n-grams; their number grows with the corpus.  All stages
are shuffles and written tables, so lost executors cost the tasks that they ran.

Cases: a null or empty text is the end token alone; words that occur in no training document have count
0; rows with a null id train nothing and are not held out; repeated rows and ids count and are scored row
by row; without training documents every token has the probability 1; an empty table gives an
empty result; other columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import gc
import re
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm.common import bound_batches, pick
from cohortweave.llm.elias_fano import Trie
from cohortweave.session import materialize_bucketed

ORDER = 3
BLOCK_TOKENS = 1 << 19
SHARD_WORDS, SHARD_GRAMS = 3 << 18, 3 << 18
#: Bytes of text that are split into words at a time.
PIECE_BYTES = 4 << 20
#: Pseudocounts: of a word, and of the shorter context's estimate in that of two and of more words.
WORD_PSEUDOCOUNT = 0.1
CONTEXT_PSEUDOCOUNT = 2.0
#: Steps of a quantised probability in a decade; a byte holds ten decades.
STEPS = 24
#: Id of the beginning of a text; words are numbered from 2 on, 0 is a word without training count.
BEGIN = 1
#: Stand for the beginning and the end of a text among its words, which hold no spaces.
BEGIN_WORD, END_WORD = b" ", b""

_GAP = re.compile(rb"[ \t-\r]")
_BLOCKS = (
    "block long, n_tokens long, n_words long, n_train long, row array<long>, doc_id array<string>, held array<boolean>, "
    "train array<boolean>, skip array<long>, length array<long>, tokens binary, words binary, counts binary"
)
_REQUESTS = "shard int, block long, data binary"
_ANSWERS = "block long, level int, shard int, data binary, tokens long, types long"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, their bytes plane by plane, compressed."""
    parts = [np.array([len(a) for a in arrays], "<u8").tobytes()]
    for a in arrays:
        width = max(1, -(-int(a.max() if len(a) else 0).bit_length() // 8))
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
        parts.append(bytes([width]) + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    """The arrays of ``packed``, as unsigned 64-bit numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    lengths = raw[: 8 * n].view("<u8").astype(np.int64)
    at, found = 8 * n, []
    for length in lengths:
        width = int(raw[at])
        wide = np.zeros((length, 8), np.uint8)
        wide[:, :width] = raw[at + 1 : at + 1 + width * length].reshape(width, length).T
        found.append(wide.view("<u8").ravel())
        at += 1 + width * length
    return found


def pieces(text: str | None, n_bytes: int) -> Iterator[tuple[bytes, bool]]:
    """A text, about ``n_bytes`` at a time and cut at gaps between words; and whether it ends there."""
    data = (text or "").encode()
    start = 0
    while True:
        gap = _GAP.search(data, start + n_bytes)
        if not gap:
            yield data[start:], True
            return
        yield data[start : gap.start()], False
        start = gap.start()


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of some texts in lower case: a code for each, how many each text has, and the words by code."""
    # both kernels know ASCII only: A-Z, and the six characters that separate words
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    found = split.flatten()
    whole = pc.greater(pc.binary_length(found), 0)
    upto = np.concatenate([[0], np.cumsum(whole.to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
    names = found.filter(whole).dictionary_encode()
    words = names.dictionary.cast(pa.large_binary()).to_pylist()
    return names.indices.to_numpy().astype(np.int64), np.diff(upto[ends]), words


class _Block:
    """Tokens of some documents as numbers of the block's own words."""

    def __init__(self, number: int) -> None:
        self.number = number
        self._numbers: defaultdict[bytes, int] = defaultdict()
        self._numbers.default_factory = self._numbers.__len__
        self._parts: list[np.ndarray] = []
        self._segments: list[tuple] = []
        self.size = 0
        #: training texts that end here
        self.n_train = 0

    def add(self, row: int, doc_id: str | None, held: bool, train: bool, skip: int, length: int, ends: bool) -> None:
        """One stretch of a document, whose first ``skip`` tokens are context and not scored."""
        self._segments.append((row, doc_id, held, train, skip, length))
        self.n_train += train and ends
        self.size += length

    def fill(self, codes: np.ndarray, words: list[bytes]) -> None:
        """The tokens of the stretches added last, as codes of ``words``."""
        used = np.flatnonzero(np.bincount(codes, minlength=len(words)))
        numbers = np.zeros(len(words), np.int64)
        numbers[used] = np.fromiter(map(self._numbers.__getitem__, map(words.__getitem__, used.tolist())), np.int64, len(used))
        self._parts.append(numbers[codes])

    def row(self) -> tuple:
        row, doc_id, held, train, skip, length = (list(c) for c in zip(*self._segments))
        tokens = np.concatenate(self._parts)
        inside = np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length)
        trained = np.repeat(train, length) & (inside >= np.repeat(skip, length))
        counts = np.bincount(tokens[trained], minlength=len(self._numbers))
        # no word holds a line feed, and the end token is the empty one
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(self._numbers))
        scored = self.size - sum(skip)
        return (
            self.number, scored, len(counts), self.n_train, row, doc_id, held, train, skip, length,
            packed(tokens), words, packed(counts),
        )


def _words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10


def blocks(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token blocks of documents (doc_id, text), in a table bucketed by block."""
    spark = docs.sparkSession
    bound_batches(spark)
    columns = [c.split()[0] for c in _BLOCKS.split(", ")]

    behind, piece_bytes = max(order - 1, 1), PIECE_BYTES

    def stretches(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple]]:
        """(row, doc_id, held, train, piece, whether the text ends there), a bounded number of bytes at a time."""
        listed, size, row = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, held, train, text in zip(*[batch[c].tolist() for c in ("doc_id", "held", "train", "text")]):
                for piece, ends in pieces(text, piece_bytes):
                    listed.append((row, doc_id, held, train, piece, ends))
                    size += len(piece)
                    if size >= piece_bytes:
                        yield listed
                        listed, size = [], 0
                row += 1
        if listed:
            yield listed

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block(TaskContext.get().partitionId() << 32)
        # the last words of a text that goes on
        tail: list[bytes] = []
        for listed in stretches(batches):
            codes, lengths, words = coded([s[4] for s in listed])
            names = [*words, BEGIN_WORD, END_WORD, *tail]
            begin, end = np.array([len(words)]), np.array([len(words) + 1])
            before = np.arange(len(words) + 2, len(names))
            parts, at = [], 0
            for (row, doc_id, held, train, _, ends), n in zip(listed, lengths.tolist()):
                context = before if len(before) else begin
                tokens = np.concatenate([context, codes[at : at + n], end] if ends else [context, codes[at : at + n]])
                at += n
                start = len(context)
                while start < len(tokens):
                    skip = min(start, behind)
                    stop = start + max(1, block_tokens - block.size)
                    part = tokens[start - skip : stop]
                    parts.append(part)
                    block.add(row, doc_id, held, train, skip, len(part), ends and stop >= len(tokens))
                    start = stop
                    if block.size >= block_tokens:
                        block.fill(np.concatenate(parts), names)
                        yield pd.DataFrame([block.row()], columns=columns)
                        block, parts = _Block(block.number + 1), []
                before = tokens[:0] if ends else tokens[-behind:]
            if parts:
                block.fill(np.concatenate(parts), names)
            tail = [names[c] for c in before]
        if block.size:
            yield pd.DataFrame([block.row()], columns=columns)

    held = F.coalesce(fold() == 0, F.lit(False))
    train = F.coalesce(fold() != 0, F.lit(False))
    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), held.alias("held"), train.alias("train"), "text")
    made = narrow.mapInPandas(cut, _BLOCKS)
    # bucketed by block, the tokens stay where they are when answers join them
    return materialize_bucketed(made, "token-blocks", ["block"])


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of ids."""
    total = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        total = (total ^ c) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        total = total * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def _sharded(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)


def _of_shards(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the ascending places that belong to it."""
    # short numbers are sorted digit by digit
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def _asked_words(found: DataFrame, shards: int) -> DataFrame:
    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, words, counts in zip(batch["block"], batch["words"], batch["counts"]):
                names, (count,) = _words(words), unpacked(counts, 1)
                rows = []
                for s, places in _of_shards(_sharded(names, shards), shards):
                    mine = b"\n".join([names[i] for i in places])
                    told = packed(count[places], np.frombuffer(mine, np.uint8))
                    rows.append((s, block, told))
                yield pd.DataFrame(rows, columns=["shard", "block", "data"])

    return found.select("block", "words", "counts").mapInPandas(ask, _REQUESTS)


def _answer_words(shards: int):
    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        asked = []
        for data in group["data"]:
            counts, text = unpacked(data, 2)
            words = text.astype(np.uint8).tobytes().split(b"\n")
            asked.append((np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), counts))
        total = np.zeros(len(numbers), np.uint64)
        for places, counts in asked:
            total[places] += counts
        # frequent words get small ids, those without training count none
        ids = np.empty(len(total), np.uint64)
        ids[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(total), dtype=np.uint64)
        ids = np.where(total > 0, ids * np.uint64(shards) + np.uint64(key[0] + BEGIN + 1), 0)
        rows = [(b, 1, key[0], packed(ids[p], total[p]), 0, 0) for b, (p, _) in zip(group["block"], asked)]
        rows[0] = (*rows[0][:4], int(total.sum()), int((total > 0).sum()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWERS.split(", ")])

    return answer


def quantised(probability: np.ndarray) -> np.ndarray:
    """Codes from 1 (probability 1) to 255 of the logarithm."""
    return np.clip(np.rint(-np.log10(probability) * STEPS) + 1, 1, 255).astype(np.uint8)


#: Probability of every code; 0: not stored.
DECODED = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def _distinct_keys(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key of so many bits, ascending by key, and each key's number among them."""
    place_width = np.uint64(max(0, len(key) - 1).bit_length())
    if width + place_width <= 64:
        # key and place in one number: sorting numbers is faster than sorting places by them
        both = np.sort((key << place_width) | np.arange(len(key), dtype=np.uint64))
        order, ranked = (both & ((np.uint64(1) << place_width) - np.uint64(1))).astype(np.int64), both >> place_width
    else:
        order = np.argsort(key)
        ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row of ids, ascending by row, and each row's number among them."""
    widths = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    columns, rank_width = list(columns), (len(columns[0]) - 1).bit_length()
    while sum(widths) > 64 and max(widths) > rank_width:
        # ids give way to their ranks, which are in the same order and narrower: one number sorts much faster
        widest = widths.index(max(widths))
        columns[widest] = np.unique(columns[widest], return_inverse=True)[1].astype(np.uint64)
        widths[widest] = rank_width
    if sum(widths) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, w in zip(columns, widths):
            key = (key << np.uint64(w)) | c
        return _distinct_keys(key, sum(widths))
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _answer_grams(level: int):
    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(data, level + 2) for data in group["data"]]
        lengths = [len(parts[0]) for parts in asked]
        for parts in asked:
            parts[0] = np.cumsum(parts[0])
        columns = [np.concatenate([a[i] for a in asked]) for i in range(level + 2)]
        del asked
        first, number = _distinct(columns[:level])
        grams = np.stack([c[first] for c in columns[:level]], axis=1)
        counts = np.bincount(number, weights=columns[level].astype(np.float64), minlength=len(first)).astype(np.int64)
        context = columns[level + 1][first]
        del columns
        stored = counts > 0
        code = quantised(counts[stored] / (context[stored] + CONTEXT_PSEUDOCOUNT))
        with tempfile.TemporaryFile() as file:
            trie = Trie.build(grams[stored], code, counts[stored], file)
            node = trie.find(grams)
            here = node >= 0
            codes, told = np.zeros(len(node), np.uint64), np.zeros(len(node), np.uint64)
            codes[here], told[here] = trie.codes[node[here]], trie.counts[node[here]]
            del trie
        rows, at = [], 0
        for block, length in zip(group["block"], lengths):
            mine = number[at : at + length]
            at += length
            rows.append((block, level, key[0], packed(codes[mine], told[mine]), 0, 0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWERS.split(", ")])

    return answer


class _Told:
    """A block with the answers to its requests so far."""

    def __init__(self, row: dict, shards: dict[int, int], begin_count: int) -> None:
        self._answers: dict[int, dict[int, bytes]] = defaultdict(dict)
        for a in row["answers"]:
            self._answers[a["level"]][a["shard"]] = a["data"]
        words = _words(row["words"])
        ids, counts = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for s, places in _of_shards(_sharded(words, shards[1]), shards[1]):
            ids[places], counts[places] = unpacked(self._answers[1][s], 2)
        if BEGIN_WORD in words:
            at = words.index(BEGIN_WORD)
            ids[at], counts[at] = BEGIN, begin_count
        del words
        (tokens,) = unpacked(row["tokens"], 1)
        tokens = tokens.astype(np.int64)
        self.skip, self.length = np.array(row["skip"], np.int64), np.array(row["length"], np.int64)
        ends = np.cumsum(self.length)
        segment = np.repeat(np.arange(len(ends)), self.length)
        inside = np.arange(len(tokens)) - np.repeat(ends - self.length, self.length)
        train = np.array(row["train"], bool)
        self.inside, self.segment = inside, segment
        self.scored = inside >= self.skip[segment]
        self.counted = self.scored & train[segment]
        #: the block's ids in order; ranks among them are narrow and sort alike, and 0 stays 0
        known = np.flatnonzero(ids)
        known = known[np.argsort(ids[known])]
        self._ids = np.append(np.uint64(0), ids[known])
        rank = np.zeros(len(ids), np.uint64)
        rank[known] = np.arange(1, len(known) + 1, dtype=np.uint64)
        self.ranks = rank[tokens]
        self.counts = counts[tokens]
        self._shards = shards
        self._grams: dict[int, tuple[np.ndarray, list[np.ndarray], np.ndarray]] = {}

    def grams(self, level: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(places of tokens with a whole n-gram, its distinct rows of ids, each place's number among them)."""
        if level not in self._grams:
            if level == 1:
                places = np.flatnonzero(self.ranks)
                self._grams[1] = places, [self._ids[1:]], (self.ranks[places] - np.uint64(1)).astype(np.int64)
                return self._grams[1]
            # an n-gram is the shorter one that ends before it, by its number, and one more word;
            # words ahead of the stretch count too: they are contexts
            earlier, rows, of_earlier = self.grams(level - 1)
            shorter = np.zeros(len(self.ranks) + 1, np.uint64)
            shorter[earlier + 1] = of_earlier + 1
            shorter = shorter[:-1]
            shorter[self.inside == 0] = 0
            places = np.flatnonzero((shorter > 0) & (self.ranks > 0))
            before, word = shorter[places], self.ranks[places]
            width = len(self._ids).bit_length()
            first, number = _distinct_keys((before << np.uint64(width)) | word, width + (len(rows[0]) + 1).bit_length())
            at = before[first].astype(np.int64) - 1
            self._grams[level] = places, [*[c[at] for c in rows], self._ids[word[first]]], number
        return self._grams[level]

    def training_counts(self, places: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """How often this block's training texts hold each of ``n`` n-grams."""
        return np.bincount(number[self.counted[places]], minlength=n).astype(np.uint64)

    def _answered(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of tokens with a whole n-gram, each place's number, codes and counts of the numbers)."""
        places, rows, number = self.grams(level)
        codes, counts = np.zeros(len(rows[0]), np.uint64), np.zeros(len(rows[0]), np.uint64)
        shards = self._shards[level]
        for s, mine in _of_shards(_mixed(rows) % np.uint64(shards), shards):
            codes[mine], counts[mine] = unpacked(self._answers[level][s], 2)
        return places, number, codes, counts

    def gram_counts(self, level: int) -> np.ndarray:
        """Training count of the n-gram that ends at each token, 0 where there is none."""
        if level == 1:
            return self.counts
        places, number, _, counts = self._answered(level)
        found = np.zeros(len(self.ranks), np.uint64)
        found[places] = counts[number]
        return found

    def estimates(self, upto: int, smallest: np.ndarray) -> np.ndarray:
        """Probability of every token by contexts of up to ``upto`` - 1 words."""
        probability = smallest
        context = self.context_counts(self.counts)
        for level in range(2, upto + 1):
            places, number, codes, counts = self._answered(level)
            backoff = CONTEXT_PSEUDOCOUNT / (context + CONTEXT_PSEUDOCOUNT)
            probability = backoff * probability
            probability[places] += DECODED[codes.astype(np.int64)][number]
            probability = np.minimum(probability, 1.0)
            if level < upto:
                count = np.zeros(len(self.ranks), np.uint64)
                count[places] = counts[number]
                context = self.context_counts(count)
        return probability

    def context_counts(self, count: np.ndarray) -> np.ndarray:
        """Training count of the n-gram that ends before each token, as the context of one more word."""
        found = np.zeros(len(count), np.float64)
        found[1:] = count[:-1]
        found[self.inside == 0] = 0
        return found


def _asked_grams(told: DataFrame, level: int, shards: dict[int, int], begin_count: int) -> DataFrame:
    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = _Told(row, shards, begin_count)
                before = block.context_counts(block.gram_counts(level - 1))
                places, rows, number = block.grams(level)
                counts = block.training_counts(places, number, len(rows[0]))
                of_row = np.zeros(len(counts), np.uint64)
                of_row[number] = before[places].astype(np.uint64)
                out = []
                for s, mine in _of_shards(_mixed(rows) % np.uint64(shards[level]), shards[level]):
                    ids = [c[mine] for c in rows]
                    # ascending first ids differ little
                    ids[0] = np.diff(ids[0], prepend=np.uint64(0))
                    out.append((s, row["block"], packed(*ids, counts[mine], of_row[mine])))
                yield pd.DataFrame(out, columns=["shard", "block", "data"])

    return told.mapInPandas(ask, _REQUESTS)


def _kept(answers: DataFrame, level: int) -> DataFrame:
    """Answers dealt and written once by block, like the blocks."""
    buckets = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize_bucketed(answers.repartition(buckets, "block"), f"answers-{level}", ["block"], buckets)


def _joined(found: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with their answers; all lie bucketed by block and nothing moves."""
    told = found
    for level, each in enumerate(answers, 1):
        listed = F.collect_list(F.struct("level", "shard", "data")).alias(f"answers_{level}")
        told = told.join(each.groupBy("block").agg(listed).hint("merge"), "block", "left")
    names = [f"answers_{level}" for level in range(1, len(answers) + 1)]
    # a block of unknown words asks for nothing but its words
    return told.withColumn("answers", F.flatten(F.array_compact(F.array(*names)))).drop(*names)


def _release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, here and in the driver's JVM."""
    gc.collect()
    spark._jvm.System.gc()


def score(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every document (doc_id, text) scored by the model of those outside fold 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark = docs.sparkSession
    kind = dict(pick(docs, "doc_id").dtypes)["doc_id"]
    found = blocks(docs, order, block_tokens)
    n_tokens, n_words, begins = found.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)),
        F.coalesce(F.sum("n_words"), F.lit(0)),
        F.coalesce(F.sum("n_train"), F.lit(0)),
    ).first()
    shards = {1: max(1, -(-n_words // SHARD_WORDS))}
    shards |= {level: max(1, -(-n_tokens // SHARD_GRAMS)) for level in range(2, order + 1)}
    asked = _asked_words(found, shards[1])
    answers = [_kept(asked.groupBy("shard").applyInPandas(_answer_words(shards[1]), _ANSWERS), 1)]
    trained, types = answers[0].agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    for level in range(2, order + 1):
        asked = _asked_grams(_joined(found, answers), level, shards, begins)
        answers.append(_kept(asked.groupBy("shard").applyInPandas(_answer_grams(level), _ANSWERS), level))
        del asked
        _release_shuffles(spark)
    whole = trained + WORD_PSEUDOCOUNT * (types + 1)

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = _Told(row, shards, begins)
                single = np.minimum((block.counts + WORD_PSEUDOCOUNT) / whole, 1.0)
                probability = block.estimates(order, single)
                n = len(block.length)

                def summed(values: np.ndarray) -> np.ndarray:
                    return np.bincount(block.segment, weights=np.where(block.scored, values, 0.0), minlength=n)

                yield pd.DataFrame(
                    {
                        "row": row["row"],
                        "doc_id": row["doc_id"],
                        "held_out": row["held"],
                        "n_tokens": (block.length - block.skip),
                        "n_known": summed(block.counts > 0).astype(np.int64),
                        "base_score": summed(np.log10((block.counts + WORD_PSEUDOCOUNT) / whole)),
                        "score": summed(np.log10(probability)),
                    }
                )

    scored = _joined(found, answers).mapInPandas(
        add_up, "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")]
    # added up in a fixed order, whichever part of a long text comes first
    logs = [F.aggregate(F.sort_array(F.collect_list(c)), F.lit(0.0), lambda a, b: a + b).alias(c) for c in ("base_score", "score")]
    return (
        scored.groupBy("row", "doc_id", "held_out")
        .agg(*sums, *logs)
        .select(
            F.col("doc_id").cast(kind), "held_out", "n_tokens", "n_known",
            F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )
