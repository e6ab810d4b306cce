"""The registered queries on the smallest tables."""

import hashlib
import os

import pytest

from strataflow.llm.queries import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_covers_its_table(spark, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name.startswith("op9"):
        n = spark.read.parquet(f"{SF}/pages.parquet").count()
    elif name.startswith(("op2", "op10", "op11", "op13")):
        return
    elif name.startswith("op12"):
        n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    else:
        n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n


def test_decoding_gives_the_texts_back(spark):
    got = {r["doc_id"]: r["decoded_sha256"] for r in queries()["op5_sentencepieces"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= names and len({r["doc_id"] for r in got}) == len(got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
