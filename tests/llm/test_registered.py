import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import compare, connect
from obsgauge.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
            "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9": {"doc_id": "bigint", "n_removed": "bigint", "kept_text": "string"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
             "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
             "folded_root": "string", "verified": "boolean"},
}


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    want = COLUMNS[name.split("_")[0]]
    assert {c: kinds.get(c) for c in want} == want
    if name.startswith("op11"):  # rows are found pairs, compared with SQL below
        assert df.count() > 100
        return
    table = "pages" if name.startswith("op2") else "documents"
    assert df.count() == duckdb.sql(f"select count(*) from '{FOLDER}/{table}.parquet'").fetchall()[0][0]


def test_queries_against_sql(spark):
    for name, sql in queries.ORACLE.items():
        assert compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], sql) is None


def test_pipeline_stages_hand_documents_on(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        assert docs.count() > 100, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == docs.count() == corpus_pipeline.run(spark, FOLDER).count()


def test_pipeline_stages_take_awkward_and_empty_documents(spark, awkward, nothing):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name
        out = stage(spark, docs, FOLDER)
        assert out.count() > 0, name
