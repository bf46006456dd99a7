"""The pipeline over the smallest tables, and on an empty one."""

import os

import pytest

import corpus_pipeline
from foliarc.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_stages(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert name == "encoding" or out.columns == first.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert 0 < docs.count() <= 3 * first.count() and docs.filter("n_tokens < 0").count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
