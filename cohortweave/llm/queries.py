"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import (
    bpe,
    embedding_dedup,
    language_id,
    license_scan,
    ngram_model,
    packing,
    pii,
    prefix_trie,
    probminhash,
    quality_ledger,
    secret_scan,
    turn_repair,
    url_reputation,
)
from cohortweave.llm.common import pick, read_table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document and the known sentences that it holds."""
    return license_scan.scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentences", ",").alias("sentences"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.linked(read_table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the default policy."""
    failed = F.col("failed")
    return quality_ledger.ledger(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_ledger.passes(failed, quality_ledger.BASE_POLICY)).alias("base_failed"),
        quality_ledger.passes(failed).alias("kept"),
        failed,
    )


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; a label of a page's id says whether the page is bad."""
    labels = pick(read_table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic").filter(
        "quality IS NOT NULL OR toxic IS NOT NULL"
    )
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("is_bad"))
    return url_reputation.judge(read_table(spark, sf_dir, "pages"), outcomes)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    spans = F.col("spans")
    fixed = secret_scan.KINDS[:3]
    return secret_scan.find_spans(docs, model).select(
        "doc_id",
        *[secret_scan.count_kind(spans, kind).alias(f"n_{kind}") for kind in fixed],
        F.sha2(secret_scan.span_text(spans, fixed).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document; the least id of a class is kept."""
    return probminhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


#: Stands for a key from the user's own store of secrets.
DEMONSTRATION_KEY = b"a key for the registered query"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data, and how many of each kind."""
    found = pii.pseudonymise(read_table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    kinds = F.transform("found", lambda f: f["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select("doc_id", "text", *counts)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and offset; the ids stay in the written pieces."""
    return packing.pack(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside fold 0."""
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    fold = language_id.fold()
    profiles = language_id.learn(docs.filter(fold != 0))
    return language_id.predict(docs.drop("lang"), profiles).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every damaged conversation."""
    return turn_repair.repair(turn_repair.damage(read_table(spark, sf_dir, "conversations")), live="live")


def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a trigram model of the documents outside fold 0."""
    return ngram_model.score(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.turns(read_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_probminhash_dedup": op7_probminhash_dedup,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_turn_repair": op11_turn_repair,
    "op12_ngram_scores": op12_ngram_scores,
    "op13_prefix_trie": op13_prefix_trie,
}
