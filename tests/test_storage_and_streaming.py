"""Sinks, seed loading, folder scans and streaming jobs."""

import json
import tempfile


from foliarc.sources import corpus, seed, sinks
from foliarc.streaming import jobs


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_replace_documents_rewrites_only_their_rows(spark):
    path = folder() + "/index"
    stored = spark.createDataFrame([(i, "r1", f"c{i}") for i in range(20)], "document_id int, revision_id string, chunk_id string")
    sinks.write_index(stored, path, buckets=4)
    fresh = spark.createDataFrame([(3, "r1", "new-a"), (3, "r1", "new-b")], stored.schema)
    sinks.replace_documents(path, fresh, ["document_id", "revision_id"])
    got = sorted(r.chunk_id for r in sinks.read_index(spark, path).collect())
    assert got == sorted([f"c{i}" for i in range(20) if i != 3] + ["new-a", "new-b"])


def test_prune_and_remove_rewrite_the_stored_index(spark):
    path = folder() + "/index"
    stored = spark.createDataFrame([(i, r, f"c{i}{r}") for i in range(12) for r in ("r1", "r2")], "document_id int, revision_id string, chunk_id string")
    sinks.write_index(stored, path)
    assert sinks.index_buckets(spark, path) == 1
    sinks.write_index(stored, path, buckets=5)
    sinks.prune_index(path, spark.createDataFrame([(1, "r2"), (2, "r1")], "document_id int, keep_revision_id string"))
    left = {(i, r) for i in range(12) for r in ("r1", "r2")} - {(1, "r1"), (2, "r2")}
    assert {(r.document_id, r.revision_id) for r in sinks.read_index(spark, path).collect()} == left
    # All documents but one go, so most buckets become empty and must not keep their files.
    sinks.remove_from_index(path, spark.createDataFrame([(i,) for i in range(12) if i != 3], "document_id int"))
    assert {(r.document_id, r.revision_id) for r in sinks.read_index(spark, path).collect()} == {(3, "r1"), (3, "r2")}


def test_append_absent_and_audit(spark):
    path = folder() + "/ir"
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    sinks.append_absent(rows, path, ["k"])
    sinks.append_absent(spark.createDataFrame([("b", 2), ("c", 2)], rows.schema), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    trail = folder() + "/audit"
    sinks.append_audit(spark.sql("SELECT 1 AS id, timestamp'2024-01-02 03:04:05' AS created_at"), trail)
    assert str(spark.read.parquet(trail).first().day) == "2024-01-02"


def test_scan_decode_and_gate(spark):
    root = folder()
    for name, data in (("a.txt", b"\xef\xbb\xbfhi"), ("b.md", b"\xff\xfe"), ("c.csv", b"x"), ("d.txt", b"y" * 50)):
        with open(f"{root}/{name}", "wb") as handle:
            handle.write(data)
    kept, skipped = corpus.split_supported(corpus.scan_files(spark, root))
    texts, errors = corpus.decode_texts(kept, max_bytes=20)
    assert [r.text for r in texts.collect()] == ["hi"]
    assert sorted(r.code for r in errors.collect()) == ["FILE_TOO_LARGE", "INVALID_ENCODING"]
    assert [r.reason for r in skipped.collect()] == ["UNSUPPORTED_FORMAT"]
    out = folder() + "/export"
    sinks.write_exports(spark.createDataFrame([(1, "ok", None), (2, None, "REVIEW_REQUIRED")], "consultation_id int, content string, code string"), out)
    assert [r.content for r in spark.read.json(out).collect()] == ["ok"]


def test_seed_records(spark):
    path = folder() + "/records.json"
    record = {"id": "d1", "title": "T", "documentType": "NOTE", "documentDate": "2024-01-02", "sourceType": "TEXT", "text": "LDL 4.1", "summary": "s",
              "tags": [" x ", "x"], "facts": [
                  {"type": "LAB_RESULT", "name": "LDL", "valueNumber": 4.1, "provenance": {"page": None, "sourceText": "LDL 4.1"},
                   "correction": {"valueNumber": 4.2}}, {"type": "OTHER", "name": "n"}]}
    with open(path, "w") as handle:
        json.dump([record], handle)
    out = seed.load_seed(seed.read_records(spark, path))
    facts = {r.name: r for r in out["facts"].collect()}
    assert facts["LDL"].value_number == 4.2 and facts["LDL"].original.value_number == 4.1
    assert facts["LDL"].review_status == "CORRECTED" and facts["n"].review_status == "UNREVIEWED"
    assert out["history"].count() == 1 and out["audit"].count() == 2 and out["documents"].first().tags == ["x"]


def test_ingest_skips_unchanged_and_replaces_changed(spark):
    source, output, checkpoint = folder(), folder() + "/out", folder()
    schema = "document_id string, title string, version int, text string, pages array<struct<page_number:int,text:string>>"

    def arrive(*rows):
        spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        events = jobs.document_events(spark, source, schema)
        jobs.ingest_documents(events, output, checkpoint).awaitTermination()

    arrive(("a", "A", 1, "one"), ("b", "B", 1, "two"))
    arrive(("a", "A", 1, "one"), ("b", "B", 2, "two changed"))
    got = {r.document_id: r.text for r in jobs.current_chunks(spark, output).collect()}
    assert got == {"a": "one", "b": "two changed"}
    assert spark.read.parquet(output).filter("document_id = 'a'").count() == 1


def test_ingest_refuses_old_versions_and_drops_emptied_documents(spark):
    source, output, checkpoint = folder(), folder() + "/out", folder()
    schema = "document_id string, title string, version int, text string, pages array<struct<page_number:int,text:string>>"

    def arrive(*rows):
        spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest_documents(jobs.document_events(spark, source, schema), output, checkpoint).awaitTermination()
        return {r.document_id: r.text for r in jobs.current_chunks(spark, output).collect()}

    assert arrive(("a", "A", 2, "newer"), ("b", "B", 1, "kept")) == {"a": "newer", "b": "kept"}
    assert arrive(("a", "A", 1, "older")) == {"a": "newer", "b": "kept"}
    assert arrive(("a", "A", 3, ""), ("b", "B", 1, "kept")) == {"b": "kept"}
    assert arrive(("a", "A", 4, "back")) == {"a": "back", "b": "kept"}
    assert jobs.document_state(spark, output).filter("document_id = 'b'").count() == 1


def test_fencing_and_rollup(spark):
    source = folder()
    events = spark.sql("""SELECT * FROM VALUES ('a', 'PROCESS', 2, timestamp'2024-01-01 00:00:00', 'h1'),
        ('a', 'PROCESS', 1, timestamp'2024-01-01 01:00:00', 'h1'), ('b', 'REMOVE', 1, timestamp'2024-01-02 00:00:00', 'h2')
        AS t(document_id, operation, generation, created_at, sha256)""")
    events.write.mode("append").parquet(source)
    docs = spark.sql("""SELECT * FROM VALUES ('a', 2, CAST(NULL AS timestamp)), ('b', 1, timestamp'2024-01-01 00:00:00')
        AS t(document_id, generation, deleted_at)""")
    output = folder() + "/fenced"
    stream = jobs.document_events(spark, source, events.schema)
    jobs.fence_generations(stream, lambda: docs, output, folder()).awaitTermination()
    rows = spark.read.parquet(output).collect()
    assert sorted((r.document_id, r.generation, r.outcome) for r in rows) == [
        ("a", 1, "SUPERSEDED"), ("a", 2, "CURRENT"), ("b", 1, "CURRENT")]
    newest = jobs.latest_generation(jobs.document_events(spark, source, events.schema))
    query = newest.writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.document_id, r.generation) for r in spark.table("newest").collect()) == [("a", 2), ("b", 1)]
    unique = jobs.suppress_duplicates(jobs.document_events(spark, source, events.schema), "2 days")
    jobs.append_stream(unique.select("document_id", "sha256"), folder() + "/unique", folder()).awaitTermination()
    audit = jobs.document_events(spark, source, events.schema).withColumnRenamed("operation", "action")
    rolled = jobs.audit_rollup(audit).select("window.start", "action", "events")
    query = rolled.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.action, r.events) for r in spark.table("rolled").collect()) == [("PROCESS", 2), ("REMOVE", 1)]
