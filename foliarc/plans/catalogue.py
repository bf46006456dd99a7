"""Catalogue, timeline and dashboard operators over the derived archive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliarc.functions.text import fold_case
from foliarc.functions import numbers
from foliarc.operators import catalogue as cat
from foliarc.operators import timeline as tl
from foliarc.plans import crosswalk as x
from foliarc.plans.crosswalk import ctes
from foliarc.plans.registry import Tables, query


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# ---- filters -----------------------------------------------------------------------------
@query("fil_1_catalogue", ctes("docs") + """
SELECT document_id, status FROM docs WHERE deleted_at IS NULL AND document_type = 'VISIT'
AND list_contains(tags, 'F') AND document_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def fil_1(t: Tables):
    return cat.documents_query(x.docs(t), type="VISIT", tag="F", date_from="1996-01-01",
                               date_to="1998-12-31").select("document_id", "status")


@query("fil_1_trash", ctes("docs") + """
SELECT document_id, status FROM docs WHERE deleted_at IS NOT NULL AND status = 'FAILED'""")
def fil_1_trash(t: Tables):
    return cat.documents_query(x.docs(t), deleted="true", status="FAILED").select("document_id", "status")


@query("fil_2_full_text_search", """
WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(replace(replace(lower(text),'ß','ss'),'ς','σ'),
  '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS w FROM documents)
SELECT doc_id FROM w WHERE (contains(w, ' the ') AND contains(w, ' and ') AND NOT contains(w, ' clown ')
  AND contains(w, ' of the ')) OR contains(w, ' que ')""")
def fil_2(t: Tables):
    return t.documents.filter(cat.search_condition(F.col("text"), 'the and -clown "of the" or QUE')).select("doc_id")


STEMS = [("the", ""), ("and", ""), ("ing", "ing"), ("inging", "ing"), ("inged", "ing"), ("re", "re"), ("res", "re"), ("rere", "re")]


@query("fil_2_stemmed_search", """
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(replace(lower(text),'ß','ss'),'ς','σ'), '[\\p{L}\\p{N}_]+'),
  lambda v: CASE WHEN v IN ('the', 'and') THEN '' WHEN v IN ('ing', 'inging', 'inged') THEN 'ing' WHEN v IN ('re', 'res', 'rere') THEN 're' ELSE v END),
  lambda v: v <> '') AS w FROM documents)
SELECT doc_id FROM w WHERE (list_contains(w, 'ing') AND NOT list_contains(w, 'que')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' of re ')""")
def fil_2_stems(t: Tables):
    """Inflected forms and stop words of a dictionary table; the query names other forms than the texts."""
    stems = t.documents.sparkSession.createDataFrame(STEMS, "word string, stem string")
    asked = 'inged the -que or "of and res"'
    return t.documents.filter(cat.search_condition(F.col("text"), asked, cat.stem_lookup(stems, asked))).select("doc_id")


@query("fil_3_escaped_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), '%%%')")
def fil_3(t: Tables):
    return t.documents.filter(cat.contains_literal(F.col("text"), "%%%")).select("doc_id")


@query("fil_4_period_undated", ctes("docs") + """
SELECT status, count(*) FILTER (document_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') AS in_period,
       count(*) FILTER (document_date IS NULL) AS undated FROM docs GROUP BY status""")
def fil_4(t: Tables):
    low, high = F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    return x.docs(t).groupBy("status").agg(
        F.count_if(cat.in_period(F.col("document_date"), low, high)).alias("in_period"),
        F.count_if(F.col("document_date").isNull()).alias("undated"))


@query("fil_6_readable_documents", ctes("docs", "texts", "revisions") + """
SELECT d.document_id, CAST(t.version AS BIGINT) AS active_text_version FROM docs d
LEFT JOIN revisions r ON r.revision_id = d.active_revision_id
LEFT JOIN texts t ON t.text_revision_id = r.text_revision_id
WHERE d.deleted_at IS NULL AND (d.status = 'READY' OR t.version = d.text_version)""")
def fil_6(t: Tables):
    return cat.readable_documents(x.docs(t), x.revisions(t), x.texts(t)).select(
        "document_id", *big("active_text_version"))


@query("fil_7_timeline_filter", ctes("timeline") + """
SELECT t.document_id, fact_id, d.title AS document_title FROM timeline t JOIN docs d USING (document_id)
WHERE d.deleted_at IS NULL AND event_type = 'MEDICATION' AND event_date >= DATE '1998-01-01'
AND event_date <= DATE '1998-06-30'""")
def fil_7(t: Tables):
    events = tl.rebuild_timeline(x.docs(t), x.facts(t))
    return tl.timeline_query(events, x.docs(t), type="MEDICATION", date_from="1998-01-01",
                             date_to="1998-06-30").select("document_id", "fact_id", "document_title")


@query("fil_8_record_checks", """
SELECT doc_id, concat_ws(',', CASE WHEN NOT (length(source) BETWEEN 1 AND 200) THEN 'TITLE' END,
  CASE WHEN lang NOT IN ('en', 'fr') THEN 'DOCUMENT_TYPE' END,
  CASE WHEN NOT (length(text) BETWEEN 3 AND 200000) THEN 'TEXT' END,
  CASE WHEN doc_id > 500 THEN 'DOCUMENT_DATE' END, CASE WHEN length(source || lang) > 80 THEN 'TAGS' END) AS violations
FROM documents""")
def fil_8(t: Tables):
    records = t.documents.select(
        "doc_id", F.col("source").alias("title"), "text",
        F.when(F.col("lang") == "en", "NOTE").when(F.col("lang") == "fr", "VISIT_TRANSCRIPT").otherwise("LAB_REPORT")
        .alias("document_type"),
        F.when(F.col("doc_id") > 500, F.lit("2021-02-30")).otherwise(F.lit("2020-02-29")).alias("document_date"),
        F.array(F.concat("source", "lang")).alias("tags"))
    return records.select("doc_id", F.array_join(cat.note_violations(), ",").alias("violations"))


@query("fil_10_strict_iso_date", """
WITH e AS (SELECT event_id, (2019 + user_id % 5) || '-' || lpad((1 + event_id % 13)::VARCHAR, 2, '0') || '-' ||
  lpad((1 + user_id % 31)::VARCHAR, 2, '0') AS d FROM events)
SELECT event_id, strftime(try_cast(d AS DATE), '%Y-%m-%d') AS iso FROM e""")
def fil_10(t: Tables):
    raw = F.concat_ws("-", (2019 + F.col("user_id") % 5).cast("string"),
                      F.lpad((1 + F.col("event_id") % 13).cast("string"), 2, "0"),
                      F.lpad((1 + F.col("user_id") % 31).cast("string"), 2, "0"))
    return t.events.select("event_id", F.date_format(numbers.iso_date(raw), "yyyy-MM-dd").alias("iso"))


@query("fil_12_correction_eligible", ctes("facts") + """
SELECT fact_id FROM facts WHERE active AND review_status IN ('CONFIRMED', 'CORRECTED')""")
def fil_12(t: Tables):
    return x.facts(t).filter(F.col("active") & cat.correction_eligible(F.col("review_status"))).select("fact_id")


@query("fil_13_reviewed_context", ctes("facts") + """
SELECT fact_id FROM facts WHERE active AND review_status IN ('CONFIRMED', 'CORRECTED', 'REJECTED')""")
def fil_13(t: Tables):
    return x.facts(t).filter(cat.reviewed_context_eligible(F.col("active"), F.col("review_status"))).select("fact_id")


@query("fil_14_differs_from_source", ctes("facts") + """
SELECT fact_id, name <> original_name OR value_number IS DISTINCT FROM original_number AS changed FROM facts""")
def fil_14(t: Tables):
    return x.facts(t).select("fact_id", cat.differs_from_source().alias("changed"))


@query("fil_15_current_artifact", ctes("docs", "revisions", "runs") + """
SELECT d.document_id, CASE WHEN d.deleted_at IS NULL AND d.status = 'READY' AND r.status = 'READY'
  AND r.text_version = d.text_version AND (p.run_id IS NULL OR p.run_id = r.run_id) THEN r.run_id END AS artifact
FROM docs d JOIN runs r USING (document_id) LEFT JOIN revisions p ON p.revision_id = d.active_revision_id""")
def fil_15(t: Tables):
    r = x.runs(t).select("document_id", "run_id", F.col("status").alias("run_status"),
                         F.col("text_version").alias("run_version"))
    p = x.revisions(t).select(F.col("revision_id").alias("active_revision_id"), F.col("run_id").alias("active_run"))
    joined = x.docs(t).join(r, "document_id").join(p, "active_revision_id", "left")
    return joined.select("document_id", cat.current_artifact(
        F.col("run_id"), F.col("deleted_at"), F.col("status"), F.col("run_status"), F.col("run_version"),
        F.col("text_version"), F.col("active_run"), F.col("run_id")).alias("artifact"))


# ---- projections -------------------------------------------------------------------------
@query("prj_1_column_hiding", ctes("docs") + "SELECT document_id, title, status FROM docs WHERE deleted_at IS NULL")
def prj_1(t: Tables):
    return tl.live(x.docs(t)).drop("search_text", "storage_path", "summary", "tags").select(
        "document_id", "title", "status")


@query("prj_2_fact_snapshot", ctes("facts") + """
SELECT fact_id, concat_ws('|', type, name, value_text, value_number, unit, event_date, assertion_status, review_status)
  AS snapshot FROM facts""")
def prj_2(t: Tables):
    snap = x.facts(t).select("fact_id", cat.fact_snapshot().alias("s"))
    return snap.select("fact_id", F.concat_ws("|", "s.type", "s.name", "s.value_text", "s.value_number", "s.unit",
                                              "s.event_date", "s.assertion_status", "s.review_status")
                       .alias("snapshot"))


@query("prj_3_search_text", """
SELECT doc_id, sha256(source || chr(10) || lang || chr(10) || text) AS search_hash FROM documents""")
def prj_3(t: Tables):
    return t.documents.select("doc_id", F.sha2(cat.search_text(F.col("source"), F.col("lang"), F.col("text")), 256)
                              .alias("search_hash"))


@query("prj_5_key_subset", """
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS kept FROM events""")
def prj_5(t: Tables):
    parsed = F.from_json("props", "k int, other string")
    return t.events.select("event_id", F.to_json(F.struct(parsed["k"].alias("k"))).alias("kept"))


# ---- joins -------------------------------------------------------------------------------
@query("jn_1_timeline_live_documents", ctes("timeline") + """
SELECT d.document_type, count(*) AS events FROM timeline t JOIN docs d USING (document_id)
WHERE d.deleted_at IS NULL GROUP BY d.document_type""")
def jn_1(t: Tables):
    events = tl.rebuild_timeline(x.docs(t), x.facts(t))
    kinds = tl.live(x.docs(t)).select("document_id", "document_type")
    return events.join(kinds, "document_id").groupBy("document_type").agg(F.count(F.lit(1)).alias("events"))


@query("jn_2_active_snapshot", ctes("docs", "texts", "revisions") + """
SELECT d.document_id, r.revision_id, t.content FROM docs d
LEFT JOIN revisions r ON r.revision_id = d.active_revision_id
LEFT JOIN texts t ON t.text_revision_id = r.text_revision_id""")
def jn_2(t: Tables):
    r = x.revisions(t).select("revision_id", "text_revision_id")
    c = x.texts(t).select("text_revision_id", "content")
    return (x.docs(t).join(r, F.col("active_revision_id") == F.col("revision_id"), "left")
            .join(c, "text_revision_id", "left").select("document_id", "revision_id", "content"))


@query("jn_3_fact_provenance", ctes("docs", "facts") + """
SELECT f.fact_id, d.title AS source_title FROM facts f LEFT JOIN docs d
ON d.document_id = f.document_id AND d.deleted_at IS NULL AND f.assertion_status = 'CONFIRMED'""")
def jn_3(t: Tables):
    quotes = x.facts(t).filter("assertion_status = 'CONFIRMED'").join(
        tl.live(x.docs(t)).select("document_id", F.col("title").alias("source_title")), "document_id"
    ).select("fact_id", "source_title")
    return x.facts(t).select("fact_id").join(quotes, "fact_id", "left")


@query("jn_4_ir_of_current_text", ctes("docs", "texts") + """
SELECT d.document_id, 'ir-' || t.text_revision_id AS ir_id FROM texts t JOIN docs d
ON d.document_id = t.document_id AND d.text_version = t.version AND d.deleted_at IS NULL""")
def jn_4(t: Tables):
    ir = x.texts(t).select("document_id", "text_revision_id", F.concat(F.lit("ir-"), "text_revision_id").alias("ir_id"),
                           F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    return cat.current_ir(ir, x.texts(t), x.docs(t)).select("document_id", "ir_id")


@query("jn_5_in_list", ctes("docs", "facts") + """
SELECT fact_id FROM facts WHERE document_id IN (SELECT document_id FROM docs WHERE status = 'READY')""")
def jn_5(t: Tables):
    return cat.restrict_to(x.facts(t), x.docs(t).filter("status = 'READY'"), "document_id").select("fact_id")


@query("jn_21_latest_text", ctes("docs", "texts") + """
SELECT d.document_id, CAST(d.text_version AS BIGINT) AS text_version, t.content FROM docs d
LEFT JOIN texts t ON t.document_id = d.document_id AND t.version = d.text_version""")
def jn_21(t: Tables):
    return cat.current_text(x.docs(t), x.texts(t)).select("document_id", *big("text_version"), "content")


@query("jn_22_facts_text_version", ctes("versions") + """
SELECT document_id, CAST(facts_version AS BIGINT) AS facts_version FROM versions""")
def jn_22(t: Tables):
    return cat.facts_text_version(x.docs(t), x.revisions(t), x.texts(t), x.runs(t)).select(
        "document_id", *big("facts_version"))


# ---- aggregates --------------------------------------------------------------------------
@query("agg_1_documents_by_type", ctes("docs") + """
SELECT document_type AS type, count(*) AS count FROM docs WHERE deleted_at IS NULL GROUP BY 1""")
def agg_1(t: Tables):
    return tl.by_type(x.docs(t))


@query("agg_2_documents_by_status", ctes("docs") + """
SELECT status, count(*) AS count FROM docs WHERE deleted_at IS NULL GROUP BY 1""")
def agg_2(t: Tables):
    return tl.by_status(x.docs(t))


@query("agg_3_documents_per_month", ctes("docs") + """
SELECT strftime(document_date, '%Y-%m') AS month, count(*) AS count FROM docs
WHERE deleted_at IS NULL AND document_date IS NOT NULL GROUP BY 1""")
def agg_3(t: Tables):
    return tl.over_time(x.docs(t))


@query("agg_4_live_fact_event_counts", ctes("timeline") + """
SELECT (SELECT count(*) FROM facts f JOIN docs d USING (document_id) WHERE d.deleted_at IS NULL AND f.active
  AND f.review_status <> 'REJECTED') AS facts,
  (SELECT count(*) FROM timeline t JOIN docs d USING (document_id) WHERE d.deleted_at IS NULL) AS events""")
def agg_4(t: Tables):
    d, f = x.docs(t), x.facts(t)
    return tl.live_counts(d, f, tl.rebuild_timeline(d, f))


@query("agg_5_dashboard_kpis", ctes("docs") + """
SELECT count(*) AS total_documents, count(*) FILTER (status = 'READY') AS processed_documents,
  count(*) FILTER (status IN ('FAILED', 'UNSUPPORTED_OCR_REQUIRED')) AS failed_documents,
  count(*) FILTER (status IN ('UPLOADED', 'PARSING', 'EXTRACTING', 'INDEXING')) AS pending_documents
FROM docs WHERE deleted_at IS NULL""")
def agg_5(t: Tables):
    return tl.kpis(x.docs(t))


@query("agg_6_child_counts", ctes("docs", "facts") + """
SELECT d.document_id, coalesce(n, 0) AS facts, CAST(len(d.tags) AS BIGINT) AS tag_count FROM docs d
LEFT JOIN (SELECT document_id, count(*) AS n FROM facts GROUP BY 1) USING (document_id)""")
def agg_6(t: Tables):
    counts = x.facts(t).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return x.docs(t).join(counts, "document_id", "left").select(
        "document_id", F.coalesce("n", F.lit(0)).alias("facts"), F.size("tags").cast("bigint").alias("tag_count"))


@query("agg_25_ordered_distinct_concat", """
WITH r AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL)
SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM r GROUP BY conv_id""")
def agg_25(t: Tables):
    first = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("first_turn", "role"))), lambda r: r["role"]), ",").alias("roles"))


@query("agg_24_unique_or_null", """
SELECT user_id, CASE WHEN count(DISTINCT json_extract_string(props, '$.k')) = 1
  THEN min(json_extract_string(props, '$.k')) END AS only_k,
  CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_type FROM events GROUP BY user_id""")
def agg_24(t: Tables):
    k = F.get_json_object("props", "$.k")
    # min = max is the unique value: two mergeable scalars instead of a collected set.
    return t.events.groupBy("user_id").agg(
        F.when(F.min(k) == F.max(k), F.min(k)).alias("only_k"),
        F.when(F.min("event_type") == F.max("event_type"), F.min("event_type")).alias("only_type"))


@query("agg_28_variety_checks", ctes("docs") + """
SELECT count(*) AS records, (SELECT count(DISTINCT u) FROM (SELECT unnest(tags) AS u FROM docs)) AS tags,
  count(DISTINCT year(document_date)) AS years, count(DISTINCT source_type) = 2 AS source_types_present,
  count(DISTINCT document_type) FILTER (document_type IN ('LAB_REPORT', 'NOTE', 'VISIT_TRANSCRIPT')) AS required_types
FROM docs""")
def agg_28(t: Tables):
    d = x.docs(t)
    tags = d.select(F.explode("tags").alias("u")).agg(F.countDistinct("u").alias("tags"))
    required = ["LAB_REPORT", "NOTE", "VISIT_TRANSCRIPT"]
    main = d.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(F.year("document_date")).alias("years"),
                 (F.countDistinct("source_type") == 2).alias("source_types_present"),
                 F.countDistinct(F.when(F.col("document_type").isin(required), F.col("document_type")))
                 .alias("required_types"))
    return main.select("*", F.lit(1).alias("one")).join(tags.select("tags", F.lit(1).alias("one")), "one").drop("one")


# ---- windows and sorts -------------------------------------------------------------------
@query("win_1_latest_per_document", ctes("jobs") + """
SELECT document_id, arg_max(job_id, (created_at, job_id)) AS job_id, count(*) AS jobs FROM jobs GROUP BY 1""")
def win_1(t: Tables):
    j = x.jobs(t)
    newest = cat.latest_per(j, ["document_id"], "created_at", "job_id", ascending_tie=False)
    sizes = j.groupBy("document_id").agg(F.count(F.lit(1)).alias("jobs"))
    return newest.join(sizes, "document_id").select("document_id", "job_id", "jobs")


@query("win_2_latest_stored_parse", ctes("jobs") + """
SELECT document_id, operation, job_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, operation
  ORDER BY date_trunc('day', created_at) DESC, job_id) AS r FROM jobs) WHERE r = 1""")
def win_2(t: Tables):
    j = x.jobs(t).withColumn("created_at", F.date_trunc("day", "created_at"))
    return cat.latest_per(j, ["document_id", "operation"], "created_at", "job_id").select(
        "document_id", "operation", "job_id")


@query("win_3_chunk_position", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def win_3(t: Tables):
    return tl.number_rows(t.conversations.select("conv_id", "turn"), ["conv_id"], [F.asc("turn")]).withColumn(
        "position", F.col("position").cast("bigint"))


@query("win_16_result_page", ctes("docs") + """
SELECT document_id, title, (SELECT count(*) FROM docs WHERE deleted_at IS NULL) AS total FROM docs
WHERE deleted_at IS NULL ORDER BY title DESC NULLS LAST, document_id LIMIT 20 OFFSET 40""")
def win_16(t: Tables):
    d = cat.documents_query(x.docs(t))
    page = cat.page_of(d, cat.document_order("title"), 3, 20).select("document_id", "title", F.lit(1).alias("one"))
    total = d.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    return page.join(F.broadcast(total), "one").drop("one")


@query("win_17_monthly_tail", ctes("docs") + """
SELECT strftime(document_date, '%Y-%m') AS month, count(*) AS count FROM docs
WHERE deleted_at IS NULL AND document_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def win_17(t: Tables):
    return tl.monthly_tail(tl.over_time(x.docs(t)))


@query("srt_1_user_sort", ctes("docs") + """
SELECT document_id, strftime(document_date, '%Y-%m-%d') AS document_date FROM docs WHERE deleted_at IS NULL
ORDER BY docs.document_date ASC NULLS LAST, document_id LIMIT 50 OFFSET 50""")
def srt_1(t: Tables):
    return cat.page_of(tl.live(x.docs(t)), cat.document_order("document_date", ascending=True), 2, 50).select("document_id", day("document_date"))


@query("srt_2_timeline_order", ctes("timeline") + """
SELECT document_id, fact_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM timeline
ORDER BY timeline.event_date DESC NULLS LAST, document_id, fact_id NULLS FIRST""")
def srt_2(t: Tables):
    events = tl.rebuild_timeline(x.docs(t), x.facts(t))
    return events.orderBy(*tl.timeline_order()).select("document_id", "fact_id", day("event_date"))


@query("srt_3_recent_documents", ctes("docs") + """
SELECT document_id FROM docs WHERE deleted_at IS NULL ORDER BY created_at DESC, document_id LIMIT 5""")
def srt_3(t: Tables):
    return tl.recent_documents(x.docs(t)).select("document_id")


@query("srt_3_recent_changes", "SELECT event_id AS audit_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def srt_3_changes(t: Tables):
    return tl.recent_changes(x.audit(t)).select("audit_id")


@query("srt_7_audit_history", """
SELECT event_id AS audit_id, user_id AS document_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100""")
def srt_7(t: Tables):
    return cat.page_of(x.audit(t), tl.HISTORY_ORDER, 2, 100).select("audit_id", "document_id")


@query("srt_10_tag_catalogue", ctes("docs") + "SELECT DISTINCT unnest(tags) AS name FROM docs")
def srt_10(t: Tables):
    return cat.tag_catalogue(x.docs(t))


# ---- set operations and arrays -----------------------------------------------------------
@query("set_2_union_of_ids", """
SELECT o_orderkey AS id FROM orders UNION SELECT l_partkey FROM lineitem""")
def set_2(t: Tables):
    return cat.union_ids(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_partkey").alias("id")), "id")


@query("set_3_missing_indexed", """
SELECT p_partkey AS missing FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49""")
def set_3(t: Tables):
    indexed = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("missing"))
    return cat.missing_ids(t.part.select(F.col("p_partkey").alias("missing")), indexed, "missing")


@query("set_4_confirmed_equals_linked", """
WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS linked FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS confirmed FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT k AS document_id, list_sort(linked) = list_sort(coalesce(confirmed, [])) AS same FROM a LEFT JOIN b USING (k)""")
def set_4(t: Tables):
    linked = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("member"))
    confirmed = t.lineitem.filter("l_quantity > 10").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("member"))
    return cat.sets_equal(linked, confirmed, ["document_id"], "member")


@query("set_5_tag_union", ctes("docs") + """
SELECT document_id, tags[1] || ',' || tags[2] || ',' || tags[3] || ',extra' AS tags FROM docs""")
def set_5(t: Tables):
    more = F.array(F.lit(" extra "), F.lit(""), F.concat(F.lit("  "), F.col("tags")[0]))
    return x.docs(t).select("document_id", F.array_join(
        cat.normalize_tags(F.concat("tags", more)), ",").alias("tags"))


@query("set_6_insert_if_absent", """
SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def set_6(t: Tables):
    stored = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return t.lineitem.select(F.col("l_suppkey").alias("id")).distinct().join(stored, "id", "left_anti")


@query("func_27_array_replace_remove", ctes("docs") + """
SELECT document_id, CASE WHEN tags[2] = 'F' THEN tags[1] || ',final,' || tags[3]
  WHEN tags[2] = 'O' THEN tags[1] || ',' || tags[3] ELSE array_to_string(tags, ',') END AS tags FROM docs""")
def func_27(t: Tables):
    changed = cat.delete_tag(cat.rename_tag(x.docs(t), "F", " final "), "O")
    return changed.select("document_id", F.array_join("tags", ",").alias("tags"))


@query("func_28_json_null_safe", """
SELECT event_id, json_extract_string(props, '$.k') IS NOT DISTINCT FROM CAST(user_id AS VARCHAR) AS same,
  json_extract_string(props, '$.absent') IS NOT DISTINCT FROM NULL AS absent FROM events""")
def func_28(t: Tables):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").eqNullSafe(F.col("user_id").cast("string")).alias("same"),
        F.get_json_object("props", "$.absent").eqNullSafe(F.lit(None)).alias("absent"))


@query("func_29_description", ctes("facts") + """
SELECT fact_id, concat_ws(' ', value_text, CAST(CAST(value_number AS BIGINT) AS VARCHAR), unit) AS description FROM facts""")
def func_29(t: Tables):
    return x.facts(t).select("fact_id", cat.fact_description(
        F.col("value_text"), F.col("value_number"), F.col("unit")).alias("description"))


@query("timeline_view", ctes("timeline", "versions") + """
SELECT t.document_id, t.fact_id, d.title AS document_title, coalesce(v.facts_version <> v.text_version, false)
  AS earlier_text FROM timeline t JOIN docs d USING (document_id) JOIN versions v USING (document_id)
WHERE d.deleted_at IS NULL AND t.event_date >= DATE '1999-01-01'""")
def timeline_view(t: Tables):
    d = x.docs(t)
    versions = cat.facts_text_version(d, x.revisions(t), x.texts(t), x.runs(t))
    return tl.timeline_view(tl.rebuild_timeline(d, x.facts(t)), d, versions, date_from="1999-01-01").select(
        "document_id", "fact_id", "document_title", "earlier_text")


@query("timeline_rebuild", ctes("timeline") + """
SELECT document_id, fact_id, event_type, strftime(event_date, '%Y-%m-%d') AS event_date, title, description
FROM timeline""")
def timeline_rebuild(t: Tables):
    return tl.rebuild_timeline(x.docs(t), x.facts(t)).withColumn("event_date", day("event_date"))


@query("dashboard_overview", ctes("timeline") + """
SELECT 'type ' || document_type AS metric, count(*) AS value FROM docs WHERE deleted_at IS NULL GROUP BY 1
UNION ALL SELECT 'status ' || status, count(*) FROM docs WHERE deleted_at IS NULL GROUP BY 1
UNION ALL SELECT 'month ' || strftime(document_date, '%Y-%m'), count(*) FROM docs
  WHERE deleted_at IS NULL AND document_date IS NOT NULL GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM docs WHERE deleted_at IS NULL
UNION ALL SELECT 'facts', count(*) FROM facts f JOIN docs d USING (document_id)
  WHERE d.deleted_at IS NULL AND f.active AND f.review_status <> 'REJECTED'
UNION ALL SELECT 'events', count(*) FROM timeline t JOIN docs d USING (document_id) WHERE d.deleted_at IS NULL""")
def dashboard(t: Tables):
    d, f = x.docs(t), x.facts(t)
    parts = tl.dashboard(d, f, tl.rebuild_timeline(d, f), x.audit(t))

    def rows(frame, label, key, value="count"):
        return frame.select(F.concat(F.lit(label), F.col(key)).alias("metric"), F.col(value).alias("value"))

    counts = parts["counts"]
    return (rows(parts["by_type"], "type ", "type").unionByName(rows(parts["by_status"], "status ", "status"))
            .unionByName(rows(parts["over_time"], "month ", "month"))
            .unionByName(parts["kpis"].select(F.lit("total").alias("metric"), F.col("total_documents").alias("value")))
            .unionByName(counts.select(F.lit("facts").alias("metric"), F.col("facts").alias("value")))
            .unionByName(counts.select(F.lit("events").alias("metric"), F.col("events").alias("value"))))


@query("revision_notice", ctes("versions") + """
SELECT d.document_id, CASE WHEN facts_version IS NOT NULL AND facts_version <> d.text_version THEN
    CASE WHEN d.status = 'FAILED' THEN 'EARLIER_TEXT_FAILED' ELSE 'EARLIER_TEXT' END
  WHEN t.version IS NULL OR t.version <> d.text_version THEN NULL
  WHEN d.status = 'FAILED' THEN 'NEW_PROCESSING_FAILED'
  WHEN d.status IN ('UPLOADED', 'INDEXING') THEN 'NEW_PROCESSING_PENDING' END AS notice
FROM docs d JOIN versions v USING (document_id) LEFT JOIN revisions r ON r.revision_id = d.active_revision_id
LEFT JOIN texts t ON t.text_revision_id = r.text_revision_id""")
def notice(t: Tables):
    d = x.docs(t)
    versions = cat.facts_text_version(d, x.revisions(t), x.texts(t), x.runs(t)).drop("text_version")
    active = x.revisions(t).join(x.texts(t).select("text_revision_id", "version"), "text_revision_id").select(
        F.col("revision_id").alias("active_revision_id"), "version")
    return d.join(versions, "document_id").join(active, "active_revision_id", "left").select(
        "document_id", cat.revision_notice(F.col("status"), F.col("text_version"), F.col("facts_version"),
                                           F.col("version") == F.col("text_version"), F.lit(False)).alias("notice"))
