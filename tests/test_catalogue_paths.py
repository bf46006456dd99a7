"""Seek paging, stems, containment joins, keyed ingest state."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from foliarc.functions.text import norm
from foliarc.operators import catalogue as cat
from foliarc.operators import scoring
from foliarc.sources import sinks
from foliarc.streaming import jobs


@pytest.mark.parametrize("up", [True, False])
def test_pages_by_token_are_the_pages_by_offset(spark, up):
    draw = random.Random(2)
    docs = spark.createDataFrame([(i, draw.choice([None, "a", "b", "c"])) for i in range(53)], "document_id int, title string").repartition(5)
    order = cat.document_order("title", up)
    whole = [(r.title, r.document_id) for r in cat.sort_documents(docs, "title", up).collect()]
    last, seen = None, []
    while True:
        page = [(r.title, r.document_id) for r in cat.next_page(docs, order, last, 10).collect()]
        if not page:
            break
        seen.append(page)
        last = page[-1]
    assert [r for page in seen for r in page] == whole and [len(p) for p in seen] == [10] * 5 + [3]
    for number in (1, 2, 4, 6):
        assert [(r.title, r.document_id) for r in cat.page_of(docs, order, number, 10).collect()] == seen[number - 1]
    assert cat.page_of(docs, order, 9, 10).count() == 0 and cat.page_of(docs.limit(0), order, 3, 10).count() == 0
    plan = cat.next_page(docs, order, last, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan


def test_search_finds_inflected_forms(spark):
    stems = spark.createDataFrame([("run", "run"), ("runs", "run"), ("running", "run"), ("мигрень", "мигрен"), ("мигрени", "мигрен"), ("the", ""), ("of", "")], "word string, stem string")
    docs = spark.createDataFrame([(1, "She runs the lab"), (2, "Running of tests"), (3, "жалобы на мигрени"), (4, "ran"), (5, None)], "document_id int, text string")

    def found(query):
        return {r.document_id for r in docs.filter(cat.search_condition(F.col("text"), query, cat.stem_lookup(stems, query))).collect()}

    assert found("run") == {1, 2} and found("мигрень") == {3} and found('"running the tests"') == {2}
    assert found("run -the") == {1, 2} and found("run -tests") == {1} and found("ran or мигрени") == {3, 4} and found("unknown") == set()


def test_containing_quotes_equal_all_pairs(spark):
    draw = random.Random(6)
    text = lambda: "".join(draw.choice("ab ") for _ in range(draw.randint(0, 14)))
    side = lambda: [("hot" if i % 3 else f"k{i % 5}", i, None if i == 7 else text()) for i in range(60)]
    g, p = side(), side()
    left, right = (spark.createDataFrame(r, "case string, idx int, quote string") for r in (g, p))
    clean = {r[0]: r[1] for df in (left, right) for r in df.select("quote", norm(F.col("quote"))).distinct().collect()}
    want = sorted((k, i, j) for k, i, a in g for m, j, b in p if k == m and a is not None and b is not None and (clean[a] in clean[b] or clean[b] in clean[a]))
    assert sorted(tuple(r) for r in scoring.containing_pairs(left, right, ["case"]).collect()) == want
    long = [("hot", i, f"sentence number {i} about a common subject " * 3) for i in range(40)]
    many = spark.createDataFrame(long, "case string, idx int, quote string")
    part = spark.createDataFrame([("hot", i, f"number {i} about") for i in range(40)], "case string, idx int, quote string")
    assert sorted((r.gold_idx, r.pred_idx) for r in scoring.containing_pairs(many, part, ["case"]).collect()) == [(i, i) for i in range(40)]


SCHEMA = "document_id string, title string, version int, text string, pages array<struct<page_number:int,text:string>>"


def test_a_batch_reads_no_earlier_output(spark, monkeypatch):
    source, output, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))

    def unread(*_):
        raise AssertionError("earlier state was read")

    def arrive(*rows):
        spark.createDataFrame([(*r, None) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with monkeypatch.context() as patch:
            patch.setattr(jobs, "document_state", unread)
            query = jobs.ingest_documents(jobs.document_events(spark, source, SCHEMA), output, checkpoint)
            query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsUpdated"]

    assert arrive(*[(f"d{i}", "T", 1, f"text {i}") for i in range(40)]) == 40
    assert arrive(("d1", "T", 1, "text 1"), ("d2", "T", 2, "text two"), ("new", "T", 1, "text")) == 2
    assert {r.document_id: r.text for r in jobs.current_chunks(spark, output).filter("batch = 1").collect()} == {"d2": "text two", "new": "text"}


def test_ingest_into_a_stored_index(spark):
    source, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    from foliarc.operators.chunks import document_chunks

    empty = spark.createDataFrame([], SCHEMA)
    sinks.write_index(document_chunks(empty), path, buckets=4)

    def arrive(*rows):
        spark.createDataFrame([(*r, None) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest_into_index(jobs.document_events(spark, source, SCHEMA), path, checkpoint).awaitTermination()
        return {r.document_id: r.text for r in sinks.read_index(spark, path).collect()}

    assert arrive(("a", "A", 2, "newer"), ("b", "B", 1, "kept")) == {"a": "newer", "b": "kept"}
    assert arrive(("a", "A", 1, "older")) == {"a": "newer", "b": "kept"}
    assert arrive(("a", "A", 3, ""), ("b", "B", 1, "kept")) == {"b": "kept"}
