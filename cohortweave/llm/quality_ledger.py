"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger stores which rules failed
(one bit each) and the measurements; policies, their versions and ablations are
then bit masks over the ledger and never read a text again.

Main path: built-in functions only.  A document is measured within its row, so
there is no shuffle and no group; cost is linear in the text but for sorting the
three-word windows of documents that repeat one.  A window is compared by a 64-bit
hash within its document (two different windows of a document of 20,000 words
meet with a chance of 1 in 10^11).

Cases: a null or blank text has no words, hence fails ``short`` (and no other rule);
repeated rows and equal ids are judged row by row; null ids stay; an empty
table gives an empty ledger; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import SPACE_CHARS, pick, settled, words

SYMBOL_GAPS = "[^#*$%&|<>]+"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
)


@dataclass(frozen=True)
class Rule:
    """A named condition for failure over the measurements; ``bit`` never changes."""

    name: str
    bit: int
    fails: str


#: Append only: stored ledgers refer to the bits.
RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeats", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "n_words > 0 AND 100 * n_symbols > 40 * n_words"),
    Rule("shouting", 3, "word_chars > 0 AND 100 * n_upper > 40 * word_chars"),
    Rule("dup_lines", 4, "100 * n_dup_lines > 60 * n_lines"),
    Rule("odd_words", 5, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: any failure among ``rules``."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {rule.name: rule.bit for rule in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE_POLICY = Policy("base", 1, ("short", "repeats"))
DEFAULT_POLICY = Policy("prose", 1, ("short", "repeats", "symbols", "shouting", "dup_lines"))


def measure(docs: DataFrame, text: str) -> DataFrame:
    """Add the columns of MEASURES to ``docs``, from its column ``text``."""
    kept = docs.columns
    split = docs.select(
        *kept,
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).select(
        *kept,
        "_text",
        words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "").alias("_lines"),
    )
    windowed = split.withColumn(
        "_windows",
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(
                    F.get(F.col("_words"), i),
                    F.get(F.col("_words"), i + 1),
                    F.get(F.col("_words"), i + 2),
                ),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # only documents that repeat a window sort their windows
    ordered = windowed.withColumn(
        "_ordered",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(
                F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
            ),
        ),
    )
    return ordered.select(
        *kept,
        settled(
            n_words=F.size("_words").cast("long"),
            word_chars=F.length(F.array_join("_words", "")).cast("long"),
            n_symbols=F.length(F.regexp_replace("_text", SYMBOL_GAPS, "")).cast("long"),
            n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            n_repeat_words=F.coalesce(_repeated_positions(F.col("_ordered")), F.lit(0)).cast("long"),
            n_lines=F.size("_lines").cast("long"),
            n_upper=F.length(F.regexp_replace("_text", "[^\\p{Lu}]+", "")).cast("long"),
        ),
    )


def _repeated_positions(ordered: Column) -> Column:
    """Number of word positions inside windows that have an equal neighbour in sorted order."""

    def position(item: Column, j: Column) -> Column:
        twin = (F.get(ordered, j - 1)["w"] == item["w"]) | (F.get(ordered, j + 1)["w"] == item["w"])
        return F.when(twin, item["i"])

    found = F.filter(F.transform(ordered, position), lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))


def failure_bits(rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, MEASURES and ``failed`` (bits)."""
    measured = measure(pick(docs, "doc_id", "text"), "text")
    return measured.select("doc_id", *MEASURES, failure_bits(rules).alias("failed"))


def passes(failed: Column, policy: Policy = DEFAULT_POLICY, rules: Sequence[Rule] = RULES) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(
    kept_ledger: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES
) -> DataFrame:
    """What each rule of each policy does: documents that it fails, that only it fails,
    and what the policy keeps with and without it.

    The ledger is first counted by its bits: at most 2^rules rows leave the scan.
    """
    counts = kept_ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    lines = [
        F.struct(
            F.lit(policy.name).alias("policy"),
            F.lit(policy.version).alias("version"),
            F.lit(rule.name).alias("rule"),
            F.lit(policy.mask(rules)).cast("long").alias("mask"),
            F.lit(1 << rule.bit).cast("long").alias("bit"),
        )
        for policy in policies
        for rule in rules
        if rule.name in policy.rules
    ]
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    others = F.col("mask").bitwiseXOR(F.col("bit"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return (
        counts.select("failed", "n", F.inline(F.array(*lines)))
        .groupBy("policy", "version", "rule")
        .agg(
            total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(hit == F.col("bit")).alias("n_only_this"),
            total(hit == 0).alias("n_kept"),
            total(F.col("failed").bitwiseAND(others) == 0).alias("n_kept_without"),
        )
    )


def with_failed(docs: DataFrame, name: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` (its columns as they are, one of them ``text``) and the failure bits as ``name``."""
    inner = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_given"))
    measured = measure(inner, "_given").withColumn(name, failure_bits(rules))
    return measured.select("_row.*", name)
