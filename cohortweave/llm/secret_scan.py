"""Secrets in texts: fixed forms, and character Markov models for the rest.

Two models of character pairs, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  A candidate (a run of token characters)
is a secret if its log-likelihood ratio between them passes a threshold.

Main path: built-in functions only.  Offsets come from a mark put around
each match: the marked text is split at the marks, every second part is a match,
and running sums of the parts' lengths are the offsets, in code points.  A document is
scanned within its row: no shuffle, no group.  The only data that moves are pair counts of
the training sample (at most ``len(ALPHABET)``^2 rows).

Cases: a null text counts as empty and has no spans; repeated rows and equal ids
are scanned row by row; null ids stay; without labelled samples both models are uniform
and add no span; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import pick, settled

#: The forms that are always secrets, and the least length of their value.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LENGTH = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

#: Characters of candidates and identifiers, in the order of the model's rows.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
CANDIDATE = r"[A-Za-z0-9+/_.=-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.-]{5,}"

KINDS = ("assign", "access", "hex", "model")

#: The models learn from at most this many documents, those with the least md5 of their id.
TRAINING_DOCUMENTS = 20_000
#: A candidate is a secret if its ratio is at least this, in nats, in all and per pair.
LEAST_RATIO = 8.0
LEAST_PER_PAIR = 0.4
#: Pairs that the smoothing adds to each first character.
SMOOTHING = 8

_MARK = "\x01"
_PLAIN = "\x02"
_BLOCK = 64


def running_sums(values: Column) -> Column:
    """Sum of all earlier elements for each element of an array of integers.

    Sums run over blocks of elements and then inside a block, so long arrays
    don't cost the square of their length.
    """
    n = F.size(values)
    zero = F.lit(0)

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, v: a + v)

    blocks = F.when(
        n > 0,
        F.transform(
            F.sequence(zero, F.floor((n - 1) / _BLOCK).cast("int")),
            lambda b: F.struct(total(F.slice(values, b * _BLOCK + 1, _BLOCK)).alias("s")),
        ),
    ).otherwise(F.array().cast("array<struct<s:int>>"))
    sums = F.transform(blocks, lambda b: b["s"])
    return F.flatten(
        F.transform(
            sums,
            lambda _, b: F.transform(
                F.slice(values, b * _BLOCK + 1, _BLOCK),
                lambda _, i: total(F.slice(sums, 1, b)) + total(F.slice(values, b * _BLOCK + 1, i)),
            ),
        )
    )


@dataclass(frozen=True)
class PairModel:
    """Log-likelihood ratio of each character pair, row by row over ALPHABET."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        # one constant, parsed when the plan is made
        return F.split(F.lit(",".join(repr(r) for r in self.ratios)), ",").cast("array<double>")


def pair_ratios(random: dict[str, int], ordinary: dict[str, int]) -> PairModel:
    """Ratios from pair counts of both classes.

    A pair's chance after its first character is smoothed toward the chance of its
    second character anywhere (which has one added to every count), so pairs never seen weigh by
    the characters that they consist of.
    """

    def logs(counts: dict[str, int]) -> list[float]:
        single = [sum(counts.get(a + b, 0) for a in ALPHABET) + 1 for b in ALPHABET]
        total = sum(single)
        out = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + SMOOTHING * n / total for b, n in zip(ALPHABET, single)]
            out += [math.log(n / sum(row)) for n in row]
        return out

    return PairModel(tuple(round(r - o, 6) for r, o in zip(logs(random), logs(ordinary))))


def train(samples: DataFrame) -> PairModel:
    """Model from labelled strings: ``sample`` and ``is_random``."""
    chars = pick(samples, "sample", "is_random").filter("sample IS NOT NULL AND is_random IS NOT NULL")
    # split once: taking each pair out of the string would read it from its start
    split = chars.select("is_random", settled(letters=F.array_remove(F.split("sample", ""), "")))
    n = F.size("letters")
    firsts, seconds = F.slice("letters", F.lit(1), n - 1), F.slice("letters", F.lit(2), n - 1)
    pairs = split.filter(n > 1).select(
        "is_random", F.explode(F.zip_with(firsts, seconds, lambda a, b: F.concat(a, b))).alias("pair")
    )
    known = pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_.=-]{2}$"))
    counts = known.groupBy("is_random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    return pair_ratios(
        {r.pair: r.n for r in counts if r.is_random}, {r.pair: r.n for r in counts if not r.is_random}
    )


def labelled_samples(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Strings labelled by form: the values of fixed forms are random, identifiers are not.

    From the ``documents`` documents with the least md5 of their id (a bounded
    sample for training; scanning reads everything).
    """
    narrow = pick(docs, "doc_id", "text").filter("text IS NOT NULL")
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = narrow.select(key.alias("_key")).filter("_key IS NOT NULL").orderBy("_key").limit(documents)
    last = ids.agg(F.max("_key").alias("k")).first()["k"]
    sample = narrow.filter(key <= F.lit(last)) if last is not None else narrow.limit(0)
    fixed = F.array_distinct(
        F.concat(
            F.filter(
                F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= ASSIGN_LENGTH
            ),
            F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
            F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
        )
    )
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = F.array_distinct(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)))
    return sample.select(
        F.inline(
            F.concat(
                F.transform(fixed, lambda v: F.struct(v.alias("sample"), F.lit(True).alias("is_random"))),
                F.transform(ordinary, lambda v: F.struct(v.alias("sample"), F.lit(False).alias("is_random"))),
            )
        )
    )


def _parts(text: Column, pattern: str) -> Column:
    """Text around and inside the matches of a pattern, in turn."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)


def _matches(parts: Column, starts: Column) -> Column:
    """(start, end, match) of every second part."""
    return F.filter(
        F.transform(
            F.arrays_zip(parts.alias("part"), starts.alias("start")),
            lambda p, i: F.struct(
                F.when(i % 2 == 1, p["start"]).alias("start"),
                (p["start"] + F.length(p["part"])).alias("end"),
                p["part"].alias("match"),
            ),
        ),
        lambda s: s["start"].isNotNull(),
    )


def ratio(candidate: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a string of ALPHABET."""
    width = len(ALPHABET)
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(
        F.filter(codes, lambda c: c > 0),
        zero,
        lambda a, c: F.struct(
            (a["sum"] + F.when(a["last"] > 0, F.get(ratios, (a["last"] - 1) * width + c - 1)).otherwise(0.0)).alias("sum"),
            c.alias("last"),
        ),
        lambda a: a["sum"],
    )


def find_spans(docs: DataFrame, model: PairModel, text: str = "text", to: str = "spans") -> DataFrame:
    """``docs`` with an array of (start, end, kind) by start and kind; kind is a place in KINDS."""
    kept = docs.columns
    plain = docs.select(
        *kept, F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _PLAIN).alias("_text")
    )
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    parts = plain.select(*kept, *[_parts(F.col("_text"), p).alias(f"_{k}") for k, p in patterns.items()])
    lengths = parts.select(
        "*",
        *[
            F.when(F.size(f"_{k}") > 1, running_sums(F.transform(f"_{k}", lambda p: F.length(p)))).alias(f"_{k}_at")
            for k in KINDS
        ],
    )

    def spans(kind: str, keep) -> Column:
        found = F.filter(_matches(F.col(f"_{kind}"), F.col(f"_{kind}_at")), keep)
        numbered = F.transform(
            found, lambda s: F.struct(s["start"], s["end"], F.lit(KINDS.index(kind)).alias("kind"))
        )
        none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
        return F.when(F.size(f"_{kind}") > 1, numbered).otherwise(none)

    constant = model.column()

    def random_looking(s: Column) -> Column:
        score = ratio(s["match"], constant)
        return (score >= LEAST_RATIO) & (score >= LEAST_PER_PAIR * (F.length(s["match"]) - 1))

    found = F.concat(
        spans("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= ASSIGN_LENGTH),
        spans("access", lambda s: F.lit(True)),
        spans("hex", lambda s: F.lit(True)),
        spans("model", random_looking),
    )
    return lengths.select(*kept, settled(**{to: F.array_sort(found)}))


def span_text(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    wanted = F.filter(spans, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))
    return F.array_join(
        F.transform(
            wanted,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, with_: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans replaced; overlapping spans count as one."""
    # spans are by start: a stretch begins where no earlier span reaches
    state = F.struct(
        F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts")
    )

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["end"] + 1, F.greatest(s["start"] - a["end"], F.lit(0)))
        fresh = (s["start"] > a["end"]) | (a["end"] == 0)
        return F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when(fresh, F.concat(a["parts"], F.array(gap, F.lit(with_)))).otherwise(a["parts"]).alias("parts"),
        )

    done = F.aggregate(
        spans,
        state,
        step,
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["end"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def hide(docs: DataFrame, model: PairModel) -> DataFrame:
    """``docs`` (its columns as they are) with secrets in ``text`` replaced and ``n_chars`` corrected."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_given"))
    found = find_spans(rows, model, "_given", "_spans")
    changed = F.size("_spans") > 0
    hidden = found.withColumn("_hidden", redact(F.col("_given"), F.col("_spans")))
    columns = []
    for name in docs.columns:
        old = F.col("_row").getField(name)
        if name.lower() == "text":
            old = F.col("_hidden")
        elif name.lower() == "n_chars":
            old = F.when(changed, F.length("_hidden").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return hidden.select(*columns)
