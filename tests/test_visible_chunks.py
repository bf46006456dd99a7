"""Retrieval works on what it may read, in slices that do not grow with the table."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliarc.operators import retrieve
from foliarc.plans import registry, retrieval


def test_superseded_revisions_are_not_split(spark, monkeypatch):
    seen, split = [], retrieval.ch.document_chunks
    monkeypatch.setattr(retrieval.ch, "document_chunks", lambda docs, **k: (seen.append({r[0] for r in docs.select("revision_id").distinct().collect()}), split(docs, **k))[1])
    rows = retrieval.indexed_chunks(registry.Tables(spark, "/root/testdata/sf0.001")).select("document_id", "revision_id").distinct().collect()
    assert seen == [{"r2"}] and rows and all(r["revision_id"] == "r2" and r["document_id"] % 10 != 9 for r in rows)


def test_slices_hold_few_words_and_every_row_once():
    draw = np.random.default_rng(4)
    words = [[f"w{i}" for i in range(n)] for n in [*draw.integers(0, 400, 3000), retrieve.SLICE_VALUES + 5, 1]]
    words[7] = None
    batch = pa.RecordBatch.from_pydict({"scope": [i % 2 for i in range(len(words))], "day": [None] * len(words), "chunk_id": list(range(len(words))), "words": words})
    models = {0: {"ids": [1]}, 1: {"ids": [1, 2]}}
    met = []
    for _, ids, days, mine in retrieve._scope_slices(iter([batch]), models, "words"):
        assert len(mine) == len(ids) == len(days) and mine.to_pylist() == [words[i] for i in ids]
        assert len(ids) == 1 or len(mine.flatten()) <= retrieve.SLICE_VALUES
        met += ids
    assert sorted(met) == list(range(len(words)))


def test_bucket_counts_are_those_of_each_word(spark):
    texts = ["a b a", "", None, "...", "Straße STRASSE ς σ x_1 a", "ж 1 1 1"] * 5
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("t", retrieve.hashed_vector(F.col("t")).alias("v")).collect()
    for row in rows:
        if row["t"] is None:
            assert row["v"] is None
            continue
        want = [0.0] * 32
        for word in re.findall(r"\w+", row["t"].lower().replace("ß", "ss").replace("ς", "σ")):
            want[int(hashlib.sha256(word.encode()).hexdigest()[:8], 16) % 32] += 1
        assert row["v"] == want
    plan = spark.range(1).select(retrieve.hashed_vector(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan
