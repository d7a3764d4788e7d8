"""Every registered query: against its SQL, or its shape."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortweave.llm.queries import QUERIES
from cohortweave.llm.sql import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.partition("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    order = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    places = [columns.index(c) for c in order]
    assert sorted(columns) == order
    expected = sorted(repr([row[i] for i in places]) for row in found.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == expected


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op2_secret_scan", "doc_id n_assign n_access n_hex base_sha256 spans"),
        ("op6_byte_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"),
        ("op9_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op10_language_id", "doc_id held_out lang_pred score"),
        ("op12_ngram_scores", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    ],
)
def test_columns(spark, name, columns):
    df = QUERIES[name](spark, SMALL)
    assert df.columns == columns.split()
    assert df.count() >= 200


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SMALL).cache()
        assert docs.columns == before.columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
