"""The pipeline, and that registered queries keep to their columns."""

import os

import pytest

import corpus_pipeline
from hibiki.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = {r.doc_id for r in docs.collect()}
    assert rows and {r.doc_id for r in rows} <= ids
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op3_toxicity", "op5_pii", "op7_fingerprints"])
def test_one_row_per_document(spark, name):
    found = Q.QUERIES[name](spark, SF_DIR)
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
