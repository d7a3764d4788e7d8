"""A training-data pipeline over ``documents``: languages, quality, near copies, secrets, packing.

Every stage gets what its predecessor wrote, so a failed stage or lost executors cost at most one
stage.  All stages but the last return the columns that they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import language_id, packing, probminhash, quality_ledger, secret_scan
from cohortweave.llm.common import free_name, read_table
from cohortweave.session import materialize


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; profiles are learned from the labelled ones outside fold 0."""
    profiles = language_id.learn(docs.filter(language_id.fold() != 0))
    return language_id.keep_known(docs, profiles)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy of the quality ledger."""
    name = free_name(docs, "quality")
    return quality_ledger.with_failed(docs, name).filter(quality_ledger.passes(F.col(name))).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    return secret_scan.hide(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its sequence and its offset there."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_languages),
    ("quality rules", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_sequences),
]

#: Learned language profiles, register sketches and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
