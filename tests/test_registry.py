"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from foliarc.plans import registry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
# At the smallest size these have no row, or two line items share the key that stands for an id.
LARGER = {"agg_20_error_types", "jn_3_fact_provenance", "legacy_coverage", "score_lab", "set_6_insert_if_absent", "src_9_corpus_audit"}
registry.load_all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    folder = FOLDER.replace("0.001", "0.01") if name in LARGER else FOLDER
    assert oracle.compare(spark, oracle.connect(folder), folder, name) is None


def test_names_and_twins():
    known, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(known)
    assert len(twins) > 200
