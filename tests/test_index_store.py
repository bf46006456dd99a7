"""The stored index: growth, crashes, settings, statistics."""

import tempfile

import pytest
from pyspark.sql import functions as F

from foliarc.operators import retrieve
from foliarc.sources import index_store, sinks

SCHEMA = "document_id int, revision_id string, chunk_id string, text string"


def rows(spark, ids, mark):
    return spark.createDataFrame([(i, "r1", f"{mark}{i}-{k}", f"word{i % 7} {mark} common") for i in ids for k in range(2)], SCHEMA)


def content(spark, path):
    return sorted(r.chunk_id for r in sinks.read_index(spark, path).collect())


def test_buckets_split_as_the_index_grows(spark, monkeypatch):
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 50)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    sinks.write_index(rows(spark, range(5), "a"), path)
    assert sinks.index_buckets(spark, path) == 1
    for step in range(4):
        sinks.replace_documents(path, rows(spark, range(step * 125, step * 125 + 130), "b"), ["document_id", "revision_id"])
    state = index_store.snapshot(spark, path)
    assert len(state["buckets"]) >= 10 and max(b["rows"] for b in state["buckets"]) <= 100
    assert sum(2.0 ** -b["depth"] for b in state["buckets"]) == 1  # the suffixes part all hashes
    assert content(spark, path) == sorted(f"b{i}-{k}" for i in range(505) for k in range(2))
    before = {b["folder"] for b in state["buckets"]}
    sinks.remove_from_index(path, spark.createDataFrame([(7,)], "document_id int"))
    after = {b["folder"] for b in index_store.snapshot(spark, path)["buckets"]}
    assert len(before - after) == 1 and content(spark, path) == sorted(f"b{i}-{k}" for i in range(505) if i != 7 for k in range(2))


def test_first_write_is_cut_to_size(spark, monkeypatch):
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 50)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    sinks.write_index(rows(spark, range(400), "a"), path)
    state = index_store.snapshot(spark, path)
    assert len(state["buckets"]) == 16 and max(b["rows"] for b in state["buckets"]) <= 100 and len(content(spark, path)) == 800


def test_a_crash_before_the_switch_changes_nothing(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    sinks.write_index(rows(spark, range(10), "a"), path)
    before = content(spark, path)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(index_store, "commit", crash)
        with pytest.raises(OSError):
            sinks.replace_documents(path, rows(spark, range(10), "b"), ["document_id", "revision_id"])
    assert content(spark, path) == before
    sinks.replace_documents(path, rows(spark, range(3), "b"), ["document_id", "revision_id"])
    assert content(spark, path) == sorted([f"b{i}-{k}" for i in range(3) for k in range(2)] + [f"a{i}-{k}" for i in range(3, 10) for k in range(2)])
    assert sorted(r.chunk_id for r in sinks.read_index(spark, path, version="000000000001").collect()) == before
    assert sinks.vacuum(spark, path, keep=1) == 2 and len(content(spark, path)) == 20
    assert sinks.vacuum(spark, path, keep=1) == 0


def test_overtaken_changes_and_other_settings_are_refused(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    sinks.write_index(rows(spark, range(3), "a"), path, settings={"chunk_size": 900})
    state = index_store.snapshot(spark, path)
    with pytest.raises(RuntimeError, match="CONCURRENT_INDEX_CHANGE"):
        index_store.commit(spark, path, state)
    assert sinks.read_index(spark, path, {"chunk_size": 900}).count() == 6
    with pytest.raises(ValueError, match="INDEX_SETTINGS_MISMATCH"):
        sinks.read_index(spark, path, {"chunk_size": 1400})
    with pytest.raises(FileNotFoundError):
        sinks.read_index(spark, path + "-none")


def test_statistics_follow_the_changes(spark, monkeypatch):
    monkeypatch.setattr(index_store, "MOST_DELTAS", 3)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    sinks.write_index(rows(spark, range(20), "a"), path, buckets=4, statistics=True)
    for step in range(3):
        sinks.replace_documents(path, rows(spark, range(step, step + 6), f"b{step}"), ["document_id", "revision_id"])
    sinks.remove_from_index(path, spark.createDataFrame([(0,), (19,)], "document_id int"))
    want = retrieve.word_counts(sinks.read_index(spark, path))
    got = index_store.index_counts(spark, path).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    asked = spark.createDataFrame([(1, "word3 common"), (2, "b2")], "question_id int, text string")
    stored = sinks.read_index(spark, path)
    ranks = [retrieve.sparse_ranks(asked, stored, 4, counts).orderBy("question_id", "sparse_rank").select("chunk_id", F.round("score", 6)).collect()
             for counts in (None, index_store.index_counts(spark, path))]
    assert ranks[0] == ranks[1]
