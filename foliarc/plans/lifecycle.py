"""Lifecycle, consultation and evidence operators over the derived archive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.operators import catalogue as cat
from foliarc.operators import chunks as ch
from foliarc.operators import consult, evidence, lifecycle, redact, retrieve, scoring
from foliarc.functions import redaction
from foliarc.plans import crosswalk as x
from foliarc.plans.crosswalk import ctes
from foliarc.plans.registry import Tables, query
from foliarc.session import spread

BIG = "bigint"


@query("register_documents", """
WITH f AS (SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text),
s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'fr')
SELECT doc_id AS document_id, h AS sha256, 'PROCESS' AS operation FROM f ANTI JOIN s USING (h)""")
def register(t: Tables):
    incoming = t.documents.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.lit("NOTE").alias("document_type"),
        F.lit(None).cast("date").alias("document_date"), "text", F.array("lang", F.lit(" ")).alias("tags"),
        F.lit(None).cast("timestamp").alias("created_at"))
    stored = t.documents.filter("lang = 'fr'").select(F.sha2("text", 256).alias("sha256"),
                                                      F.lit(None).cast("timestamp").alias("deleted_at"))
    out = lifecycle.register_documents(incoming, stored)
    return out["documents"].join(out["jobs"].select("document_id", "operation"), "document_id").select(
        "document_id", "sha256", "operation")


def _facts(t: Tables):
    """Facts with their revision: statements of the newer runs are incoming."""
    f = x.facts(t)
    incoming = F.col("assertion_status") == "UNKNOWN"
    return f.withColumn("revision_id", F.when(incoming, F.concat(F.lit("next-"), F.col("document_id")))).withColumn(
        "active", F.col("active") & ~incoming).withColumn("review_status", F.when(incoming, F.lit("UNREVIEWED")).otherwise(
            F.col("review_status")))


INCOMING = """
fx AS (SELECT *, assertion_status = 'UNKNOWN' AS inc FROM facts),
pre AS (SELECT * FROM fx WHERE NOT inc AND active AND review_status <> 'UNREVIEWED'),
ids AS (SELECT document_id, type, lower(name) AS name, event_date FROM pre UNION SELECT document_id, type,
  'original part ' || split_part(name, ' ', 2), event_date FROM pre WHERE review_status = 'CORRECTED'),
vis AS (SELECT fact_id FROM fx WHERE inc AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.document_id = fx.document_id
  AND i.type = fx.type AND i.name = lower(fx.name) AND i.event_date IS NOT DISTINCT FROM fx.event_date))"""


@query("jn_6_anti_disjunctive", ctes("facts") + "," + INCOMING + "SELECT fact_id FROM vis")
def jn_6(t: Tables):
    f = _facts(t)
    preserved = f.filter(F.col("active") & (F.col("review_status") != "UNREVIEWED"))
    return lifecycle.suppressed_by_review(f.filter(F.col("revision_id").isNotNull()), preserved).select("fact_id")


@query("activate_revisions", ctes("docs", "facts") + "," + INCOMING + """
SELECT f.document_id, count(*) FILTER (CASE WHEN d.document_id IS NULL THEN f.active AND NOT inc WHEN inc THEN v.fact_id IS NOT NULL
  ELSE f.active AND f.review_status <> 'UNREVIEWED' END) AS active_facts FROM fx f LEFT JOIN vis v USING (fact_id)
LEFT JOIN docs d ON d.document_id = f.document_id AND d.status = 'READY' GROUP BY 1""")
def activate(t: Tables):
    d = x.docs(t)
    prepared = d.filter("status = 'READY'").select("document_id", F.concat(F.lit("next-"), "document_id").alias("revision_id"))
    found = prepared.select("revision_id", F.lit("VISIT").alias("document_type"), F.lit(None).cast("date").alias("document_date"),
                            F.lit("new summary").alias("summary"), F.array(F.lit("new")).alias("tags"), F.lit("text").alias("content"))
    out = lifecycle.activate_revisions(prepared, _facts(t), d, x.revisions(t), found)
    return out["facts"].groupBy("document_id").agg(F.count_if("active").alias("active_facts"))


def _activated(t: Tables):
    d = x.docs(t)
    prepared = d.filter("status = 'READY'").select("document_id", F.concat(F.lit("next-"), "document_id").alias("revision_id"))
    found = prepared.select("revision_id", F.lit("VISIT").alias("document_type"), F.lit(None).cast("date").alias("document_date"),
                            F.lit("new summary").alias("summary"), F.array(F.lit("new")).alias("tags"), F.lit("text").alias("content"))
    manifests = prepared.select("revision_id", F.struct((F.col("document_id") % 7).alias("document_chunks")).alias("index_manifest"))
    return lifecycle.activate_revisions(prepared, _facts(t), d, x.revisions(t), found, manifests)


@query("activation_audit", ctes("docs", "facts") + "," + INCOMING + """
SELECT d.document_id, 'PROCESSING_REVISION_ACTIVATED' AS action, 'next-' || d.document_id AS revision_id,
  count(v.fact_id) AS facts, CAST(d.document_id % 7 AS BIGINT) AS chunks
FROM docs d LEFT JOIN fx f ON f.document_id = d.document_id AND f.inc LEFT JOIN vis v ON v.fact_id = f.fact_id
WHERE d.status = 'READY' GROUP BY d.document_id""")
def activation_audit(t: Tables):
    return _activated(t)["audit"].select("document_id", "action", "after.revision_id", "after.facts", "after.chunks")


@query("activated_timeline", ctes("docs", "facts") + "," + INCOMING + """
, live AS (SELECT f.document_id, f.fact_id, f.event_date FROM fx f LEFT JOIN vis v USING (fact_id) JOIN docs d ON d.document_id = f.document_id
  WHERE d.status = 'READY' AND (inc OR f.review_status <> 'REJECTED') AND CASE WHEN inc THEN v.fact_id IS NOT NULL ELSE f.active AND f.review_status <> 'UNREVIEWED' END)
SELECT document_id, NULL AS fact_id, strftime(document_date, '%Y-%m-%d') AS event_date FROM docs WHERE status = 'READY'
UNION ALL SELECT document_id, fact_id, strftime(event_date, '%Y-%m-%d') FROM live""")
def activated_timeline(t: Tables):
    return _activated(t)["timeline"].select("document_id", "fact_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@query("activated_tags", ctes("docs") + """
SELECT DISTINCT name FROM (SELECT unnest(tags) AS name FROM docs WHERE status = 'READY' UNION ALL SELECT 'new')""")
def activated_tags(t: Tables):
    return _activated(t)["tags"]


@query("activated_documents", ctes("docs") + """
SELECT document_id, CASE WHEN status = 'READY' AND document_type <> 'NOTE' THEN 'VISIT' ELSE document_type END AS document_type,
  CASE WHEN status = 'READY' THEN 'next-' || document_id ELSE active_revision_id END AS active_revision_id,
  array_to_string(tags, ',') || CASE WHEN status = 'READY' THEN ',new' ELSE '' END AS tags,
  CASE WHEN status = 'READY' THEN title || chr(10) || 'new summary' || chr(10) || 'text' ELSE search_text END AS search_text FROM docs""")
def activated_documents(t: Tables):
    d = x.docs(t)
    prepared = d.filter("status = 'READY'").select("document_id", F.concat(F.lit("next-"), "document_id").alias("revision_id"))
    found = prepared.select("revision_id", F.lit("VISIT").alias("document_type"), F.lit(None).cast("date").alias("document_date"),
                            F.lit("new summary").alias("summary"), F.array(F.lit("new")).alias("tags"), F.lit("text").alias("content"))
    out = lifecycle.activate_revisions(prepared, _facts(t), d, x.revisions(t), found)["documents"]
    return out.select("document_id", "document_type", "active_revision_id", F.array_join("tags", ",").alias("tags"), "search_text")


@query("correct_facts", ctes("facts") + """
SELECT fact_id, CASE WHEN active AND review_status = 'UNREVIEWED' THEN 99.0 ELSE value_number END AS value_number,
  CASE WHEN active AND review_status = 'UNREVIEWED' THEN 'CORRECTED' ELSE review_status END AS review_status FROM facts""")
def correct(t: Tables):
    f = x.facts(t)
    none = {n: F.lit(None).cast("string").alias(n) for n in ("type", "name", "value_text", "unit", "assertion_status")}
    edits = f.filter("review_status = 'UNREVIEWED'").select(
        "fact_id", *none.values(), F.lit(99.0).alias("value_number"), F.lit(None).cast("date").alias("event_date"),
        F.lit("CONFIRMED").alias("review_status"))
    return lifecycle.correct_facts(f, edits)["facts"].select("fact_id", "value_number", "review_status")


def _operations(t: Tables):
    revisions = x.revisions(t).select("run_id", "status")
    return lifecycle.follow_up(x.docs(t), x.jobs(t), x.runs(t), revisions)


OPERATIONS = """ops AS (SELECT d.document_id, CASE WHEN NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = d.document_id
  AND j.operation = 'PROCESS' AND j.status IN ('QUEUED', 'RUNNING')) AND r.status = 'READY' AND r.text_version = d.text_version
  THEN 'INDEX' ELSE 'PROCESS' END AS operation FROM docs d JOIN runs r USING (document_id))"""


@query("follow_up_operation", ctes("docs", "jobs", "runs") + "," + OPERATIONS + "SELECT * FROM ops")
def follow_up(t: Tables):
    return _operations(t)


@query("apply_document_edits", ctes("docs", "jobs", "runs") + "," + OPERATIONS + """
SELECT document_id, CASE WHEN status = 'FAILED' AND deleted_at IS NULL THEN 'Edited' ELSE title END AS title,
  CAST(text_version + (document_type = 'NOTE' AND status = 'FAILED' AND deleted_at IS NULL)::INT AS BIGINT) AS text_version,
  CAST(generation + (status = 'FAILED' AND deleted_at IS NULL)::INT AS BIGINT) AS generation,
  CASE WHEN status = 'FAILED' AND deleted_at IS NULL THEN CASE WHEN document_type = 'NOTE' OR operation = 'PROCESS' THEN 'UPLOADED'
    ELSE 'INDEXING' END ELSE status END AS status FROM docs JOIN ops USING (document_id)""")
def document_edits(t: Tables):
    d = x.docs(t)
    none = F.lit(None).cast("string")
    edits = d.filter("status = 'FAILED'").select(
        "document_id", F.lit("Edited").alias("title"), none.alias("document_type"), F.lit(None).cast("date").alias("document_date"),
        none.alias("summary"), F.lit(None).cast("array<string>").alias("tags"),
        F.when(F.col("document_type") == "NOTE", F.lit("New text")).alias("text"))
    out = lifecycle.apply_document_edits(d, edits, x.texts(t), _operations(t))["documents"]
    return out.select("document_id", "title", F.col("text_version").cast(BIG).alias("text_version"),
                      F.col("generation").cast(BIG).alias("generation"), "status")


@query("soft_delete", ctes("docs") + """
SELECT document_id, deleted_at IS NOT NULL OR document_type = 'VISIT' AS deleted,
  CAST(generation + (document_type = 'VISIT' AND deleted_at IS NULL)::INT AS BIGINT) AS generation FROM docs""")
def soft_delete(t: Tables):
    d = x.docs(t)
    out = lifecycle.soft_delete(d, d.filter("document_type = 'VISIT'"), F.lit("2024-01-01").cast("timestamp"))["documents"]
    return out.select("document_id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("generation").cast(BIG).alias("generation"))


@query("restore_documents", ctes("docs", "jobs", "runs") + "," + OPERATIONS + """
SELECT document_id, deleted_at IS NOT NULL AND status <> 'READY' AS deleted, CASE WHEN deleted_at IS NOT NULL AND status = 'READY' THEN
  CASE WHEN operation = 'INDEX' THEN 'INDEXING' ELSE 'UPLOADED' END ELSE status END AS status FROM docs JOIN ops USING (document_id)""")
def restore(t: Tables):
    d = x.docs(t)
    out = lifecycle.restore(d, d.filter("status = 'READY'"), _operations(t))["documents"]
    return out.select("document_id", F.col("deleted_at").isNotNull().alias("deleted"), "status")


@query("reprocess_modes", ctes("docs", "texts") + """
SELECT document_id, concat_ws(',', CASE WHEN document_type = 'NOTE' OR text_version > 2 THEN 'CURRENT_TEXT' END,
  CASE WHEN storage_path IS NOT NULL THEN 'ORIGINAL' END) AS modes FROM docs""")
def modes(t: Tables):
    d = x.docs(t)
    kinds = d.select("document_id", "document_type")
    texts = x.texts(t).join(kinds, "document_id").withColumn(
        "page_count", F.when(F.col("document_type") == "NOTE", F.lit(0)).otherwise(F.lit(2)))
    parses = x.texts(t).select("text_revision_id", F.when(F.col("version") > 2, F.lit("hash")).alias("parse_recipe_hash"))
    return lifecycle.reprocess_modes(d, texts, parses).select("document_id", F.array_join("modes", ",").alias("modes"))


@query("tag_rename_delete", ctes("docs") + """
SELECT CASE WHEN u = '1-urgent' THEN 'urgent' ELSE u END AS tag, count(*) AS documents
FROM (SELECT unnest(tags) AS u FROM docs) WHERE u <> '5-low' GROUP BY 1""")
def tags(t: Tables):
    changed = cat.delete_tag(cat.rename_tag(x.docs(t), "1-urgent", "urgent"), "5-low")
    return changed.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("documents"))


@query("jn_9_snapshot_consistency", ctes("docs", "facts") + """
SELECT f.name AS answer_id, bool_and(d.document_type <> 'VISIT' AND d.status <> 'FAILED') AS valid FROM facts f
JOIN docs d USING (document_id) GROUP BY 1""")
def snapshot(t: Tables):
    before = x.docs(t)
    after = before.filter("status <> 'FAILED'").withColumn("generation", F.when(
        F.col("document_type") == "VISIT", F.col("generation") + 1).otherwise(F.col("generation")))
    return lifecycle.snapshot_unchanged(before, after, x.facts(t).select(F.col("name").alias("answer_id"), "document_id"))


def consultations(t: Tables):
    """A consultation per customer over the documents of its orders."""
    o = t.orders
    return o.groupBy(F.col("o_custkey").alias("consultation_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("document_id")))).alias("source_refs"),
        F.max("o_orderdate").alias("created_at")).withColumn(
        "question", F.concat(F.lit("What about 100% of customer "), "consultation_id")).withColumn("status", F.lit("REVIEWED"))


def prompts(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("consultation_id")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("l_orderkey").alias("document_id")))).alias("source_refs"))


LINKS = """links AS (SELECT o_orderkey AS document_id, o_custkey AS consultation_id FROM orders
  UNION SELECT l_orderkey, l_suppkey FROM lineitem)"""


@query("jn_8_linked_consultations", f"WITH {LINKS} SELECT * FROM links")
def links(t: Tables):
    return lifecycle.linked_consultations(consultations(t), prompts(t))


@query("purge_gate", ctes("docs") + "," + LINKS + """
SELECT document_id, CASE WHEN deleted_at IS NULL THEN 'DOCUMENT_NOT_IN_TRASH' WHEN document_type = 'VISIT' THEN 'PURGE_NOT_CONFIRMED'
  WHEN document_type = 'NOTE' THEN 'PURGE_CONSULTATIONS_CHANGED' ELSE 'PURGE' END AS outcome FROM docs""")
def gate(t: Tables):
    d = x.docs(t)
    known = lifecycle.linked_consultations(consultations(t), prompts(t))
    confirmed = known.groupBy("document_id").agg(F.collect_list("consultation_id").alias("ids"))
    requests = d.join(confirmed, "document_id").select(
        "document_id", F.when(F.col("document_type") == "VISIT", F.lit("?")).otherwise(F.col("title")).alias("confirm_title"),
        F.when(F.col("document_type") == "NOTE", F.concat("ids", F.array(F.lit(-1).cast(BIG)))).otherwise(F.col("ids"))
        .alias("consultation_ids"))
    return lifecycle.purge_gate(requests, d, known)


@query("purge", ctes("docs", "facts") + "," + LINKS + """
, gone AS (SELECT document_id FROM docs WHERE deleted_at IS NOT NULL AND status = 'FAILED'),
lost AS (SELECT DISTINCT consultation_id FROM links SEMI JOIN gone USING (document_id))
SELECT 'documents' AS part, count(*) AS rows FROM docs ANTI JOIN gone USING (document_id)
UNION ALL SELECT 'facts', count(*) FROM facts ANTI JOIN gone USING (document_id)
UNION ALL SELECT 'history', count(*) FROM facts ANTI JOIN gone USING (document_id)
UNION ALL SELECT 'consultations', count(*) FROM (SELECT DISTINCT o_custkey AS consultation_id FROM orders) ANTI JOIN lost USING (consultation_id)
UNION ALL SELECT 'purge_audit', count(*) FROM gone""")
def purge(t: Tables):
    d, f = x.docs(t), x.facts(t)
    ids = d.filter("deleted_at IS NOT NULL AND status = 'FAILED'").select("document_id")
    tables = {"documents": d.select("document_id"), "facts": f.select("fact_id", "document_id"), "history": f.select("fact_id"),
              "consultations": consultations(t).select("consultation_id")}
    out = lifecycle.purge(tables, ids, lifecycle.linked_consultations(consultations(t), prompts(t)))
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(name)) for name, df in out.items()]
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame)
    return total


@query("shared_original_guard", ctes("docs") + """
, n AS (SELECT sha256, count(*) AS n FROM docs GROUP BY 1), gone AS (SELECT * FROM docs WHERE deleted_at IS NOT NULL)
SELECT document_id, '/files/' || sha256 AS path FROM gone JOIN n USING (sha256) WHERE n = 1 AND source_type = 'PDF' AND document_type = 'VISIT'
UNION ALL SELECT document_id, storage_path FROM gone WHERE storage_path IS NOT NULL AND document_type <> 'VISIT'""")
def originals(t: Tables):
    d = x.docs(t).withColumn("storage_path", F.when(F.col("document_type") != "VISIT", F.col("storage_path")))
    files = d.select(F.concat(F.lit("/files/"), "sha256").alias("path"), "sha256").distinct()
    return lifecycle.deletable_originals(d.filter("deleted_at IS NOT NULL"), d, files)


@query("document_detail", ctes("docs", "texts", "facts", "jobs", "runs", "revisions") + """
SELECT d.document_id, t.content, coalesce(f.n, 0) AS facts, CAST(d.text_version AS BIGINT) AS text_revisions, j.job_id AS latest_job,
  r.run_id AS latest_run, d.active_revision_id AS active_revision
FROM docs d LEFT JOIN texts t ON t.document_id = d.document_id AND t.version = d.text_version
LEFT JOIN (SELECT document_id, count(*) AS n FROM facts WHERE active GROUP BY 1) f ON f.document_id = d.document_id
LEFT JOIN (SELECT document_id, arg_max(job_id, (created_at, job_id)) AS job_id FROM jobs GROUP BY 1) j ON j.document_id = d.document_id
LEFT JOIN runs r ON r.document_id = d.document_id""")
def detail(t: Tables):
    out = lifecycle.document_detail(x.docs(t), x.facts(t), x.texts(t), x.jobs(t), x.runs(t), x.revisions(t))
    return out.select("document_id", "content", F.size("facts").cast(BIG).alias("facts"),
                      F.size("text_revisions").cast(BIG).alias("text_revisions"), "latest_job", "latest_run",
                      F.col("active_revision.revision_id").alias("active_revision"))


@query("build_recipes", """
SELECT doc_id AS document_id, sha256('{"normalizerVersion":"whitespace-map-v1","parserVersion":"' || source ||
  '","recipeVersion":"processing-recipe-v1","sourceIRVersion":"source-ir-v1","stage":"SOURCE_ONLY"}') AS parse_hash,
  CASE WHEN lang = 'de' THEN NULL ELSE 'm1' END AS model, 'medical-structure-v1' AS chunker FROM documents""")
def recipes(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("parser_version"),
                              F.when(F.col("lang") == "de", F.lit("lab")).otherwise(F.lit("legacy")).alias("method"))
    settings = {"model": "m1", "model_digest": "d", "profile": "clinical-v1", "chunk_size": 900, "chunk_overlap": 120,
                "embedding_model": "e", "embedding_digest": None, "max_facts_per_batch": 8}
    built = lifecycle.build_recipes(docs, settings)
    return built.select("document_id", F.get_json_object("recipe", "$.parse.recipeHash").alias("parse_hash"),
                        F.get_json_object("recipe", "$.model").alias("model"),
                        F.get_json_object("recipe", "$.index.chunkerVersion").alias("chunker"))


@query("func_33_recipe_equality", "SELECT doc_id, lang <> 'fr' AS same FROM documents")
def recipe_equality(t: Tables):
    from foliarc.functions.hashing import canonical_hash
    size = F.when(F.col("lang") == "fr", F.lit(901)).otherwise(F.lit(900))
    used = F.struct(F.lit(120).alias("chunkOverlap"), size.alias("chunkSize"), "source")
    want = F.struct(F.lit(120).alias("chunkOverlap"), F.lit(900).alias("chunkSize"), "source")
    return t.documents.select("doc_id", (canonical_hash(used) == canonical_hash(want)).alias("same"))


@query("verify_artifact_spans", """
SELECT doc_id AS document_id, CASE WHEN lang = 'fr' THEN 'ARTIFACT_SOURCE_MISMATCH' ELSE 'ROW_SOURCE_MISMATCH' END AS code
FROM documents WHERE lang IN ('fr', 'de')""")
def artifact_spans(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.array(F.struct(
        F.lit(1).alias("page_number"), "text")).alias("pages"), F.lit("ir").alias("ir_hash"))
    line = F.substring_index("text", "\n", 1)
    spans = t.documents.select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("page_index"), F.lit(0).alias("start_byte"),
        F.octet_length(line).alias("end_byte"), F.when(F.col("lang") == "de", F.concat(line, F.lit("!"))).otherwise(line).alias("source_text"),
        F.when(F.col("lang") == "fr", F.lit("old")).otherwise(F.lit("ir")).alias("ir_hash"))
    return lifecycle.verify_artifact_spans(spans, docs).select("document_id", "code")


# ---- index sinks as projections ----------------------------------------------------------
@query("jn_7_store_reconciliation", """
SELECT CASE WHEN p_partkey IS NULL THEN 'remove' WHEN l_partkey IS NULL THEN 'insert' ELSE 'keep' END AS action, count(*) AS ids
FROM part FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) ON p_partkey = l_partkey GROUP BY 1""")
def reconcile(t: Tables):
    from foliarc.sources.sinks import reconcile_ids
    wanted = t.part.select(F.col("p_partkey").alias("chunk_id"))
    stored = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("chunk_id")).distinct()
    return reconcile_ids(wanted, stored).groupBy("action").agg(F.count(F.lit(1)).alias("ids"))


@query("snk_2_prune_superseded", """
SELECT l_orderkey AS document_id, count(*) AS chunks FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'F' OR l_returnflag = 'A' GROUP BY 1""")
def prune(t: Tables):
    from foliarc.sources.sinks import prune_superseded
    chunks = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.nullif("l_returnflag", F.lit("N")).alias("revision_id"))
    keep = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"), F.lit("A").alias("keep_revision_id"))
    return prune_superseded(chunks, keep).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("snk_3_remove_document", """
SELECT count(*) AS chunks FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def remove(t: Tables):
    from foliarc.sources.sinks import remove_documents
    ids = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"))
    return remove_documents(t.lineitem.withColumnRenamed("l_orderkey", "document_id"), ids).agg(F.count(F.lit(1)).alias("chunks"))


@query("snk_1_chunk_upsert", """
SELECT l_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS origin, count(*) AS chunks
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def upsert(t: Tables):
    from foliarc.sources.sinks import upsert_chunks
    ids = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    stored = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.lit("r").alias("revision_id"), F.lit("old").alias("origin"))
    fresh = stored.join(ids, "document_id", "left_semi").withColumn("origin", F.lit("new"))
    return upsert_chunks(stored, fresh, ["document_id", "revision_id"]).groupBy("document_id", "origin").agg(F.count(F.lit(1)).alias("chunks"))


@query("src_7_seed_guard", """
SELECT false AS same_dataset, true AS own_dataset""")
def seed_guard(t: Tables):
    from foliarc.sources.seed import seed_allowed
    seeds = t.orders.select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit(True).alias("is_seed"))
    other = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("document_id"))
    every = t.orders.select(F.col("o_orderkey").cast("string").alias("document_id"))
    one = F.lit(1).alias("one")
    a = seed_allowed(seeds, other).select(F.col("allowed").alias("same_dataset"), one)
    b = seed_allowed(seeds, every).select(F.col("allowed").alias("own_dataset"), one)
    return a.join(b, "one").drop("one")


# ---- consultations -----------------------------------------------------------------------
@query("prepare_consultations")
def prepare(t: Tables):
    c = consultations(t).withColumn("document_ids", F.transform("source_refs", lambda r: r["document_id"]))
    asked = c.select("consultation_id", "question", "document_ids")
    # Every fifth document is cited, every tenth by a blank excerpt that falls back to the text.
    cited = asked.select("consultation_id", F.explode("document_ids").alias("document_id")).filter("document_id % 5 = 0")
    snippets = cited.select("consultation_id", "document_id", F.lit(0).alias("ord"), F.when(
        F.col("document_id") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Excerpt of "), F.col("document_id").cast("string"))).alias("text"))
    done = consult.prepare_consultations(asked, x.docs(t), x.texts(t), x.facts(t), snippets, max_documents=vocab.CONSULTATION_DOCUMENTS)
    return done.select("consultation_id", "code", "status", "content_hash")


@query("prepare_consultation_codes", ctes("docs") + """
, c AS (SELECT o_custkey AS consultation_id, count(*) AS n, bool_or(d.deleted_at IS NOT NULL OR d.status <> 'READY') AS bad
  FROM orders JOIN docs d ON d.document_id = o_orderkey GROUP BY 1)
SELECT consultation_id, CASE WHEN n > 8 THEN 'CONTEXT_LIMIT' WHEN bad THEN 'SOURCE_UNAVAILABLE' END AS code FROM c""")
def prepare_codes(t: Tables):
    return prepare(t).select("consultation_id", "code")


def drafts(t: Tables):
    """A draft per document text; three of four languages were reviewed."""
    d = t.documents
    content = F.when(F.col("lang") == "es", F.concat(F.lit("see file notes.pdf "), "text")).otherwise(F.col("text"))
    h = F.sha2(content, 256)
    return d.select(F.col("doc_id").alias("consultation_id"), content.alias("content"), h.alias("content_hash"),
                    F.when(F.col("lang") == "de", F.lit("old")).otherwise(h).alias("reviewed_hash"),
                    F.when(F.col("lang") == "fr", F.lit("NEEDS_REVIEW")).otherwise(F.lit("REVIEWED")).alias("status"), "lang")


@query("snk_6_gated_export", """
SELECT doc_id AS consultation_id, CASE WHEN lang IN ('de', 'fr') THEN 'REVIEW_REQUIRED' WHEN lang = 'es' THEN 'PRIVACY_CHECK_FAILED' END AS code,
  CASE WHEN lang = 'en' THEN sha256(text) END AS passed FROM documents""")
def export(t: Tables):
    return consult.export_gate(drafts(t)).select("consultation_id", "code", F.sha2("content", 256).alias("passed"))


@query("review_export_gate", """
SELECT doc_id AS consultation_id, lang <> 'es' AS reviewed FROM documents""")
def review(t: Tables):
    d = drafts(t).drop("lang")
    reviews = t.documents.select(F.col("doc_id").alias("consultation_id"), F.when(
        F.col("lang") == "es", F.lit("stale")).otherwise(F.sha2("text", 256)).alias("content_hash"))
    none = d.select("consultation_id", "content_hash").filter("false")
    out = consult.review_drafts(d, reviews, none)
    kept = out["prompts"].select("consultation_id", F.lit(True).alias("reviewed"))
    return kept.unionByName(out["refused"].select("consultation_id", F.lit(False).alias("reviewed")))


@query("add_response_idempotent", """
SELECT conv_id || '-' || turn AS response_id, CASE WHEN role = 'system' THEN 'PROMPT_VERSION_REQUIRED' WHEN turn > 5 THEN 'CREATED'
  WHEN turn = 3 THEN 'CONFLICT' ELSE 'EXISTING' END AS outcome FROM conversations""")
def responses(t: Tables):
    rows = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), F.col("conv_id").alias("consultation_id"),
                                  F.col("role").alias("prompt_id"), F.lit(" m ").alias("model"), F.col("text").alias("content"), "turn")
    stored = rows.filter("turn <= 5").withColumn("model", F.lit("m")).withColumn("content", F.when(
        F.col("turn") == 3, F.lit("other")).otherwise(F.col("content"))).drop("turn")
    known = t.conversations.filter("role <> 'system'").select(F.col("conv_id").alias("consultation_id"), F.col("role").alias("prompt_id"))
    return consult.add_responses(rows.drop("turn"), stored, known)


@query("backfill_prompts", "SELECT doc_id AS consultation_id FROM documents WHERE lang <> 'de'")
def backfill(t: Tables):
    return consult.backfill_prompts(drafts(t)).select("consultation_id")


@query("consultation_list", """
SELECT c.id AS consultation_id, c.n AS source_count, coalesce(r.n, 0) AS response_count FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) c
LEFT JOIN (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1) r USING (id)""")
def consultation_list(t: Tables):
    answers = t.lineitem.select(F.col("l_suppkey").alias("consultation_id"))
    return consult.list_consultations(consultations(t), answers, "100% OF").select(
        "consultation_id", F.col("source_count").cast(BIG).alias("source_count"), "response_count")


@query("consultation_detail", """
SELECT conv_id AS consultation_id, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'assistant') AS responses,
  arg_min(sha256(text), turn) FILTER (role = 'user') AS first_prompt FROM conversations GROUP BY 1""")
def consultation_detail(t: Tables):
    c = t.conversations.select(F.col("conv_id").alias("consultation_id"), F.col("turn").alias("created_at"), F.col("text").alias("content"), "role")
    out = consult.consultation_detail(c.select("consultation_id").distinct(), c.filter("role = 'user'").withColumn("prompt_id", F.col("created_at")),
                                      c.filter("role = 'assistant'").withColumn("response_id", F.col("created_at")))
    return out.select("consultation_id", F.when(
        F.col("prompts").isNull(), F.lit(0)).otherwise(F.size("prompts")).cast(BIG).alias("prompts"),
        F.when(F.col("responses").isNull(), F.lit(0)).otherwise(F.size("responses")).cast(BIG).alias("responses"),
        F.sha2(F.get("prompts", F.lit(0))["content"], 256).alias("first_prompt"))


@query("srt_9_context_budget", """
WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)
SELECT conv_id, turn FROM s WHERE total <= 1500""")
def budget(t: Tables):
    return consult.budget_prefix(t.conversations, ["conv_id"], ["turn"], F.length("text"), 1500).select("conv_id", "turn")


@query("snk_7_public_references", """
SELECT conv_id AS response_id, 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS reference, turn AS position FROM conversations""")
def references(t: Tables):
    rows = t.conversations.groupBy(F.col("conv_id").alias("response_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("position"), F.col("role").alias("source")))).alias("sources"))
    return evidence.public_references(rows).select("response_id", "reference", "position")


# ---- redaction ---------------------------------------------------------------------------
@query("func_16_contact_masking")
def contacts(t: Tables):
    return spread(t.documents, "doc_id").select("doc_id", F.sha2(redaction.mask_contacts(F.col("text")), 256).alias("h"))


@query("func_17_labelled_values", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '[IDENTIFIER] ok; again [IDENTIFIER]. [DOB].' AS text FROM lineitem""")
def labelled(t: Tables):
    number = F.concat(F.lit("A"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    text = F.concat(F.lit("Patient ID: "), number, F.lit(" ok; again "), number, F.lit(". DOB "), F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit("."))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             redaction.mask_labelled(text, redaction.labelled_values(text)).alias("text"))


@query("func_18_known_people", """
SELECT c_custkey, 'Doctor: [DOCTOR_A] saw [PERSON_B]. [DOCTOR_A] agreed, stone 5 mm. ' || lower(c_mktsegment) AS text FROM customer""")
def people(t: Tables):
    name = F.initcap(F.translate(F.substring("c_name", -4, 4), "0123456789", "abcdefghij"))
    text = F.concat(F.lit("Doctor: Marko X"), F.lower(name), F.lit(" saw Mr. Y"), F.lower(name), F.lit(". Marko agreed, stone 5 mm. "), F.lower("c_mktsegment"))
    return spread(t.customer, "c_custkey").select("c_custkey", redaction.mask_people(text, redaction.people(text)).alias("text"))


@query("func_19_protected_values", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS VARCHAR) || ' mg' AS first_quantity,
  strftime(l_shipdate, '%Y-%m-%d') AS first_date, 'not' AS negation FROM lineitem""")
def protected(t: Tables):
    text = F.concat(F.lit("took "), F.col("l_quantity").cast("string"), F.lit(" mg, not more, on "), F.date_format("l_shipdate", "yyyy-MM-dd"))
    p = redaction.protected_values(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             F.get(p["quantities"], F.lit(0)).alias("first_quantity"), F.get(p["dates"], F.lit(0)).alias("first_date"),
                             F.get(redaction.negations(text), F.lit(0)).alias("negation"))


@query("func_20_numeric_collision", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity = l_suppkey AS collides FROM lineitem""")
def collision(t: Tables):
    context = F.concat(F.lit("MRN: "), F.col("l_suppkey").cast("string"))
    field = F.concat(F.lit("count was "), F.col("l_quantity").cast("int").cast("string"), F.lit(" cells"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", redaction.identifier_collision(
        field, redaction.numeric_identifiers(context)).alias("collides"))


def _packages(t: Tables):
    """A turn and a note full of identifiers per package; the last turns have a missing field, an id that is also a count, or no fields."""
    number = F.concat_ws("-", F.lit("A"), F.lpad(F.col("conv_id").cast("string"), 7, "0"))
    note = F.concat(F.lit("Alina Petrova wrote from user"), F.col("conv_id").cast("string"), F.lit("@mail.org, patient id: "), number,
                    F.lit(", took 5 mg of it; kept in scans/page"), F.col("turn").cast("string"), F.lit(".pdf, again "), number, F.lit("."))
    twice = F.concat(F.lit("MRN: 77"), F.col("conv_id").cast("string"), F.lit(", count 77"), F.col("conv_id").cast("string"), F.lit(" cells"))
    fields = F.when(F.col("turn") == 7, F.array(F.col("text"), F.lit(None).cast("string"))).when(
        F.col("turn") == 6, F.array(F.col("text"), twice)).when(F.col("turn") == 5, F.lit(None).cast("array<string>")).otherwise(F.array(F.col("text"), note))
    return spread(t.conversations, "conv_id", "turn").select(
        F.concat_ws("-", "conv_id", "turn").alias("package_id"), fields.alias("fields"),
        F.concat(F.lit("Patient: Alina Petrova, role "), "role").alias("identifier_context"))


NOTE_SQL = """'[PERSON_A] wrote from [EMAIL], [IDENTIFIER], took 5 mg of it; kept in [LOCAL_PATH], again [IDENTIFIER].'"""


@query("redact_packages", f"""
SELECT conv_id || '-' || turn AS package_id, CASE WHEN turn < 5 THEN text END AS first, CASE WHEN turn < 5 THEN {NOTE_SQL} END AS second,
  CASE WHEN turn IN (5, 7) THEN 'PRIVACY_CHECK_FAILED' WHEN turn = 6 THEN 'CLINICAL_CONTENT_CHANGED' END AS code FROM conversations""")
def redact_packages(t: Tables):
    return redact.redact(_packages(t)).select("package_id", F.get("texts", F.lit(0)).alias("first"), F.get("texts", F.lit(1)).alias("second"), "code")


@query("apply_identifier_spans", f"""
SELECT conv_id || '-' || turn AS package_id, CASE WHEN turn IN (1, 2, 4) THEN text END AS first,
  CASE WHEN turn IN (1, 4) THEN {NOTE_SQL} WHEN turn = 2 THEN replace({NOTE_SQL}, 'wrote', '[CLINIC_A]') END AS second,
  CASE WHEN turn IN (0, 3, 5, 7) THEN 'PRIVACY_CHECK_FAILED' WHEN turn = 6 THEN 'CLINICAL_CONTENT_CHANGED' END AS code,
  CASE WHEN turn = 1 THEN 'SPAN_NOT_REPLACEABLE' WHEN turn = 4 THEN 'SPAN_WITH_NUMBERS_OR_NEGATION' ELSE '' END AS warnings FROM conversations""")
def identifier_spans(t: Tables):
    # By turn: an unlisted category, part of a word, a word, a NULL text, a quantity.
    span = F.when(F.col("turn") == 1, F.lit("wro")).when(F.col("turn") == 3, F.lit(None).cast("string")).when(
        F.col("turn") == 4, F.lit("5 mg")).otherwise(F.lit("wrote"))
    spans = t.conversations.filter("turn < 5").select(
        F.concat_ws("-", "conv_id", "turn").alias("package_id"), F.lit(0).alias("ord"), span.alias("text"),
        F.when(F.col("turn") == 0, F.lit("SECRET")).otherwise(F.lit("CLINIC")).alias("category"))
    done = redact.apply_identifier_spans(redact.redact(_packages(t)), spans)
    return done.select("package_id", F.get("texts", F.lit(0)).alias("first"), F.get("texts", F.lit(1)).alias("second"), "code",
                       F.array_join("warnings", ",").alias("warnings"))


@query("win_12_placeholder_lettering", """
WITH r AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, '[PERSON_' || chr(CAST(65 + i + CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END AS INT)) || ']' AS label FROM r""")
def lettering(t: Tables):
    name = F.concat(F.lit("Name"), F.translate(F.lower("n_name"), "0123456789_ ", "abcdefghij"))
    rows = t.nation.select(F.col("n_regionkey").alias("package_id"), F.col("n_nationkey").alias("ord"), name.alias("text"),
                           F.lit("PERSON").alias("category"))
    packages = rows.groupBy("package_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), " and ").alias("names")).select(
        "package_id", F.array(F.concat("names", F.when(F.col("package_id") == 0, F.lit(" [PERSON_A]")).otherwise(F.lit(""))))
        .alias("texts"))
    judged = redact.judge_spans(packages, rows)
    labels = redact.span_labels(packages, judged).join(judged.select("package_id", "text", "ord"), ["package_id", "text"])
    return labels.select(F.col("ord").cast(BIG).alias("n_nationkey"), "label")


# ---- evidence ----------------------------------------------------------------------------
def _rag(t: Tables):
    """Conversations ask: the first turn is the question, the others are its chunks."""
    c = t.conversations
    chunks = c.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), "text", "turn")
    retrieved = c.filter("turn > 0").select(F.col("conv_id").alias("question_id"), F.when(F.col("turn") < 3, F.lit(0)).otherwise(F.lit(1)).alias("pass"),
                                            F.col("turn").alias("rank"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"))
    grades = c.filter("turn > 0").select(
        F.col("conv_id").alias("question_id"), F.when(F.col("turn") < 3, F.lit(0)).otherwise(F.lit(1)).alias("pass"),
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), (F.col("role") == "assistant").alias("relevant"),
        F.when(F.col("turn") == 1, F.lit("no such quote")).otherwise(F.substring("text", 1, 20)).alias("evidence"))
    return chunks, retrieved, grades


ROUTE = """
a AS (SELECT conv_id AS question_id, turn, CASE WHEN turn < 3 THEN 0 ELSE 1 END AS pass, role = 'assistant' AND turn <> 1 AND length(trim(left(text, 20))) > 0
  AS ok FROM conversations WHERE turn > 0),
s AS (SELECT question_id, pass, count(*) FILTER (ok) AS found FROM a GROUP BY ALL),
r AS (SELECT question_id, coalesce(min(pass) FILTER (found >= 1), max(pass)) AS pass, bool_or(found >= 1) AS sufficient FROM s GROUP BY 1)"""


@query("grade_and_route", f"""
WITH {ROUTE} SELECT q.question_id, CAST(coalesce(pass, 1) AS BIGINT) AS retry_count, coalesce(sufficient, false) AS sufficient
FROM (SELECT DISTINCT conv_id AS question_id FROM conversations) q LEFT JOIN r USING (question_id)""")
def grade(t: Tables):
    chunks, retrieved, grades = _rag(t)
    asked = t.conversations.select(F.col("conv_id").alias("question_id"))
    routes, _ = evidence.grade_and_route(retrieved, grades, chunks, questions=asked)
    return routes.select("question_id", F.col("retry_count").cast(BIG).alias("retry_count"), "sufficient")


@query("jn_19_citation_binding", f"""
WITH {ROUTE} SELECT question_id, turn, row_number() OVER (PARTITION BY question_id ORDER BY turn) AS citation FROM a JOIN r USING (question_id, pass) WHERE ok""")
def binding(t: Tables):
    chunks, retrieved, grades = _rag(t)
    _, relevant = evidence.grade_and_route(retrieved, grades, chunks)
    return relevant.join(chunks.select("chunk_id", "turn"), "chunk_id").select(
        "question_id", "turn", F.col("citation").cast(BIG).alias("citation"))


def _answered(t: Tables):
    """Attempt 0 misquotes in every conversation with a second relevant chunk; attempt 1 is right."""
    chunks, retrieved, grades = _rag(t)
    _, relevant = evidence.grade_and_route(retrieved, grades, chunks)
    cited = relevant.join(chunks, "chunk_id")
    good = cited.select("question_id", F.col("citation").alias("ord"), "citation", F.substring("text", 1, 40).alias("quote"))
    wrong = good.withColumn("quote", F.when(F.col("citation") > 1, F.lit("invented words")).otherwise(F.col("quote")))
    quotes = wrong.withColumn("attempt", F.lit(0)).unionByName(good.withColumn("attempt", F.lit(1)))
    questions = t.conversations.filter("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    attempts = questions.select("question_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"), F.lit(False).alias("insufficient"),
                                F.lit(None).cast("string").alias("error"))
    return evidence.assemble_answers(questions, relevant, attempts, quotes, chunks)


@query("assemble_answers", f"""
WITH {ROUTE}, c AS (SELECT a.question_id, t.text, row_number() OVER (PARTITION BY a.question_id ORDER BY a.turn) AS n
  FROM a JOIN r USING (question_id, pass) JOIN conversations t ON t.conv_id = a.question_id AND t.turn = a.turn WHERE ok),
p AS (SELECT question_id, count(*) AS n, string_agg(trim(left(text, 40), E' \\t\\n\\r') || ' [' || n || ']', E'\\n\\n' ORDER BY n) AS body FROM c GROUP BY 1)
SELECT q.conv_id AS question_id, n IS NULL AS insufficient, coalesce(n, 0) AS citations, md5(CASE WHEN n IS NULL THEN '{vocab.ABSTAIN}' ELSE
  CASE WHEN regexp_matches(q.text, '[А-Яа-яЁё]') THEN '{vocab.INTRO_RU}' ELSE '{vocab.INTRO_EN}' END || E'\\n\\n' || body END) AS answer_md5
FROM conversations q LEFT JOIN p ON p.question_id = q.conv_id WHERE q.turn = 0""")
def assemble(t: Tables):
    answers, _ = _answered(t)
    return answers.select("question_id", "insufficient", F.when(F.col("citations").isNull(), F.lit(0)).otherwise(
        F.size("citations")).cast(BIG).alias("citations"), F.md5("answer").alias("answer_md5"))


@query("win_11_citation_numbering", f"""
WITH {ROUTE} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY turn) AS citation, turn AS first_turn
FROM a JOIN r USING (question_id, pass) WHERE ok""")
def numbering(t: Tables):
    _, parts = _answered(t)
    return parts.select("question_id", F.col("citation").cast(BIG).alias("citation"),
                        F.substring_index("chunk_id", "-", -1).cast(BIG).alias("first_turn"))


def archive_questions(t: Tables):
    """Benchmark texts as archive questions; every fourth item names no period."""
    year = 1996 + F.col("item_id") % 4
    return t.benchmark.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 4 > 0, F.make_date(year, F.lit(1), F.lit(1))).alias("date_from"),
        F.when(F.col("item_id") % 4 > 1, F.make_date(year, F.lit(12), F.lit(31))).alias("date_to"),
        retrieve.hashed_vector(F.col("text")).alias("embedding"))


def archive_catalogue(t: Tables):
    """Documents dated by their id; every fifth source is undated."""
    return t.documents.select(
        F.col("doc_id").alias("document_id"), F.when(F.col("lang") != "es", F.date_add(
            F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))).alias("document_date"),
        F.when(F.col("lang") == "fr", F.lit("r2")).alias("active_revision_id"))


def archive_chunks(t: Tables):
    """One chunk per document; French documents are indexed under an older revision, so they are missing."""
    return spread(t.documents, "doc_id").select(
        F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("chunk_id"), F.col("doc_id").alias("document_id"),
        F.when(F.col("lang") == "fr", F.lit("r1")).alias("revision_id"), F.lit(1).alias("position"), "text", "source",
        F.lit(False).alias("user_correction"), retrieve.hashed_vector(F.col("text")).alias("embedding"))


ARCHIVE = """
qs AS (SELECT item_id, CASE WHEN item_id % 4 > 0 THEN make_date(CAST(1996 + item_id % 4 AS INT), 1, 1) END AS f,
  CASE WHEN item_id % 4 > 1 THEN make_date(CAST(1996 + item_id % 4 AS INT), 12, 31) END AS e FROM benchmark),
ds AS (SELECT doc_id, lang, CASE WHEN lang <> 'es' THEN DATE '1995-01-01' + CAST(doc_id % 2000 AS INT) END AS d FROM documents),
el AS (SELECT item_id, doc_id, lang FROM qs JOIN ds ON (f IS NULL AND e IS NULL) OR (d IS NOT NULL AND (f IS NULL OR d >= f) AND (e IS NULL OR d <= e)))"""


@query("agg_8_answer_coverage", f"""
WITH {ARCHIVE} SELECT item_id AS question_id, count(doc_id) AS eligible_documents, count(*) FILTER (lang <> 'fr') AS eligible_chunks,
  least(120, count(*) FILTER (lang <> 'fr')) AS scanned_chunks, count(*) FILTER (lang = 'fr') AS missing_indexed,
  (SELECT count(*) FROM ds WHERE d IS NULL) AS undated FROM qs LEFT JOIN el USING (item_id) GROUP BY item_id""")
def coverage(t: Tables):
    """Counts of a scan of at most 120 chunks; nothing is ranked to count."""
    out = evidence.archive_coverage(archive_questions(t), archive_catalogue(t), archive_chunks(t), vocab.ARCHIVE_SCAN_CHUNKS, F.lit("2024-02-29").cast("date"))
    return out.select("question_id", "eligible_documents", "eligible_chunks", "scanned_chunks", "missing_indexed", "undated")


@query("srt_6_scan_cap", f"""
WITH {ARCHIVE}, n AS (SELECT item_id, count(doc_id) FILTER (lang <> 'fr') AS n, count(*) FILTER (lang = 'fr') AS m FROM qs LEFT JOIN el USING (item_id) GROUP BY 1)
SELECT item_id AS question_id, least(120, n) AS scanned_chunks, greatest(0, n - 120) AS left_out, n <= 120 AND m = 0 AS complete FROM n""")
def scan_cap(t: Tables):
    """The best 120 chunks of each question are read, the others are listed."""
    out = evidence.select_evidence(archive_questions(t), archive_catalogue(t), archive_chunks(t), vocab.ARCHIVE_SCAN_CHUNKS, F.lit("2024-02-29").cast("date"))
    read = out["selected"].groupBy("reading").agg(F.count(F.lit(1)).alias("scanned_chunks")).join(out["readings"], "reading").drop("reading")
    left = out["left_out"].groupBy("question_id").agg(F.count(F.lit(1)).alias("left_out"))
    return out["coverage"].select("question_id", "complete").join(read, "question_id", "left").join(left, "question_id", "left").na.fill(
        0, ["scanned_chunks", "left_out"]).select("question_id", "scanned_chunks", "left_out", "complete")


@query("archive_evidence", f"""
WITH RECURSIVE {ARCHIVE},
sc AS (SELECT DISTINCT f, e FROM qs),
k AS (SELECT f, e, doc_id, lang, length(text) AS n, coalesce(d::VARCHAR, '9999') AS day,
    row_number() OVER (PARTITION BY f, e ORDER BY coalesce(d::VARCHAR, '9999'), doc_id) AS r
  FROM sc JOIN ds ON (f IS NULL AND e IS NULL) OR (d IS NOT NULL AND (f IS NULL OR d >= f) AND (e IS NULL OR d <= e)) JOIN documents USING (doc_id, lang) WHERE lang <> 'fr'),
pk AS (SELECT f, e, r, n AS size, 1 AS items, 0 AS batch FROM k WHERE r = 1
  UNION ALL SELECT k.f, k.e, k.r, CASE WHEN p.items >= 6 OR p.size + k.n > 10000 THEN k.n ELSE p.size + k.n END,
    CASE WHEN p.items >= 6 OR p.size + k.n > 10000 THEN 1 ELSE p.items + 1 END,
    CASE WHEN p.items >= 6 OR p.size + k.n > 10000 THEN p.batch + 1 ELSE p.batch END
  FROM pk p JOIN k ON k.f IS NOT DISTINCT FROM p.f AND k.e IS NOT DISTINCT FROM p.e AND k.r = p.r + 1),
rd AS (SELECT item_id, k.doc_id, k.day, k.r, pk.batch, (pk.batch + item_id) % 5 = 0 AS failed, (k.doc_id + item_id) % 40 = 0 AS quoted
  FROM qs JOIN k ON k.f IS NOT DISTINCT FROM qs.f AND k.e IS NOT DISTINCT FROM qs.e
  JOIN pk ON pk.f IS NOT DISTINCT FROM k.f AND pk.e IS NOT DISTINCT FROM k.e AND pk.r = k.r),
ev AS (SELECT *, failed AND doc_id % 3 = 0 AS lost FROM rd),
en AS (SELECT item_id, doc_id, day, text, row_number() OVER (PARTITION BY item_id ORDER BY day, doc_id) AS cite
  FROM ev JOIN documents USING (doc_id) WHERE quoted AND NOT lost),
an AS (SELECT item_id, count(*) AS cited, 'По записям архива (даты документов):\n\n' ||
    string_agg(CASE WHEN day = '9999' THEN 'Дата документа не указана' ELSE day END || ': ' ||
      trim(text, E' \t\n\r') || ' [' || cite || ']', '\n\n' ORDER BY cite) AS answer FROM en GROUP BY item_id),
fl AS (SELECT item_id, count(*) FILTER (lost) AS lost, count(*) AS chunks FROM ev GROUP BY item_id),
al AS (SELECT item_id, count(doc_id) AS docs, count(*) FILTER (lang = 'fr') AS missing FROM qs LEFT JOIN el USING (item_id) GROUP BY item_id)
SELECT q.item_id AS question_id, CASE WHEN an.item_id IS NOT NULL THEN 'EVIDENCE_FOUND' WHEN coalesce(lost, 0) > 0 THEN 'EVIDENCE_VALIDATION_FAILED'
    WHEN al.docs = 0 THEN 'NO_DOCUMENTS_IN_PERIOD' ELSE 'NO_CONFIRMED_EVIDENCE' END AS reason,
  an.item_id IS NULL AS insufficient, coalesce(cited, 0) AS citations, CASE WHEN an.item_id IS NOT NULL THEN md5(answer) END AS answer_md5,
  al.docs - al.missing AS scanned_documents, coalesce(chunks, 0) AS scanned_chunks, coalesce(lost, 0) AS failed_batches,
  al.missing = 0 AND coalesce(lost, 0) = 0 AS complete
FROM qs q JOIN al USING (item_id) LEFT JOIN an USING (item_id) LEFT JOIN fl USING (item_id)""")
def archive(t: Tables):
    """Every eligible chunk is read, one in forty is quoted in full. A fifth of the batches fails first: half of those
    in an error, half by an invented quote; read again chunk by chunk, a third of their chunks fails again."""
    chosen = evidence.select_evidence(archive_questions(t), archive_catalogue(t), archive_chunks(t), today=F.lit("2024-02-29").cast("date"))
    pairs = chosen["readings"].join(chosen["selected"], "reading")
    fails = (F.col("batch") + F.col("question_id")) % 5 == 0
    broken = fails & (F.col("batch") % 2 == 0)
    batches = chosen["readings"].join(chosen["selected"].select("reading", "batch").distinct(), "reading")
    failed = batches.filter(fails).select("question_id", "reading", "batch")
    text = chosen["chunks"].select("chunk_id", "text")
    cited = (F.col("document_id") + F.col("question_id")) % 40 == 0
    said = pairs.filter(cited | (fails & ~broken)).join(text, "chunk_id").withColumn(
        "quote", F.when(fails & ~broken, F.lit("words that no document holds")).otherwise(F.col("text")))
    again = evidence.retry_batches(chosen, failed)
    lost = F.col("document_id") % 3 == 0
    repeated = again.filter(cited & ~lost).join(text, "chunk_id").withColumn("quote", F.col("text"))
    quotes = [f.select("question_id", F.lit(n).alias("retry"), "batch", F.col("number").alias("ord"), "number", "quote") for n, f in enumerate((said, repeated))]
    errors = [f.select("question_id", F.lit(n).alias("retry"), "batch") for n, f in enumerate((batches.filter(broken), again.filter(lost)))]
    out = evidence.archive_answers(chosen, quotes[0].unionByName(quotes[1]), errors[0].unionByName(errors[1]))
    cites = out["sources"].groupBy("question_id").agg(F.count(F.lit(1)).alias("citations"))
    digests = evidence.answer_digests(out["paragraphs"])
    return out["verdicts"].join(cites, "question_id", "left").join(digests, "question_id", "left").na.fill(0, ["citations"]).select(
        "question_id", "reason", "insufficient", "citations", "answer_md5",
        "scanned_documents", "scanned_chunks", "failed_batches", "complete")


@query("win_5_diversity", """
WITH r AS (SELECT user_id AS question_id, event_type AS document_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY rank) AS k FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY k > 1, rank) AS place FROM n)
SELECT question_id, chunk_id, place FROM p WHERE place <= 12""")
def diversity(t: Tables):
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ranked = t.events.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("document_id"), F.col("event_id").alias("chunk_id"), rank.alias("rank"))
    return evidence.diversify(ranked, 12).select("question_id", "chunk_id", F.col("place").cast(BIG).alias("place"))


@query("fil_5_snapshot_visibility", """
SELECT l_orderkey AS document_id, count(*) AS chunks FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END IS NOT DISTINCT FROM CASE WHEN o_orderstatus = 'F' THEN 'A' END GROUP BY 1""")
def visibility(t: Tables):
    chunks = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.nullif("l_returnflag", F.lit("N")).alias("revision_id"))
    active = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", F.lit("A")).alias("active_revision_id"))
    return retrieve.visible_chunks(chunks, active).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("srt_5_chronological_order", """
SELECT document_id, place FROM (SELECT o_orderkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE WHEN o_totalprice >= 50000 THEN o_orderdate END ASC NULLS LAST, o_orderkey) AS place FROM orders)""")
def chronological(t: Tables):
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("document_id"), F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate")).alias("date"))
    return cat.chronological(rows, ["o_custkey"], "date", ["document_id"]).select("document_id", F.col("place").cast(BIG).alias("place"))


@query("public_packages", f"""
WITH {ROUTE}, n AS (SELECT question_id, count(*) AS n FROM a JOIN r USING (question_id, pass) WHERE ok GROUP BY 1)
SELECT conv_id AS response_id, n IS NULL AS abstained FROM conversations LEFT JOIN n ON n.question_id = conv_id WHERE turn = 0""")
def public(t: Tables):
    answers, parts = _answered(t)
    chunks, _, _ = _rag(t)
    cited = parts.join(chunks.select("chunk_id", F.col("text").alias("source_text")), "chunk_id")
    grouped = cited.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("citation", "text"))).alias("parts"),
        F.sort_array(F.collect_list(F.struct("citation", F.col("source_text").alias("text")))).alias("sources"))
    none = F.array().cast("array<struct<citation:int,text:string>>")
    rows = answers.join(grouped, "question_id", "left").select(
        F.col("question_id").alias("response_id"), "answer", "insufficient", F.coalesce("parts", none).alias("parts"), F.coalesce("sources", none).alias("sources"))
    spans = t.conversations.select(F.col("conv_id").alias("package_id"), F.lit(0).alias("ord"), F.lit("[EMAIL]").alias("text"), F.lit("CONTACT").alias("category")).filter("false")
    done = evidence.public_packages(rows, spans)
    return done.select("response_id", F.coalesce(F.col("answer") == F.lit("В архиве недостаточно подтверждённых данных для ответа на этот вопрос."), F.lit(False)).alias("abstained"))


@query("released_subset", """
SELECT conv_id AS document_id, count(*) FILTER (role = 'user') AS released FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0""")
def released(t: Tables):
    statements = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("statement_index"))
    verdicts = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("statement_index"), F.when(
        F.col("role") == "user", F.lit("AGREES")).otherwise(F.lit("UNRESOLVED")).alias("status"))
    return scoring.released_subset(statements, verdicts).groupBy("document_id").agg(F.count(F.lit(1)).alias("released"))


@query("str_2_generation_fence", ctes("docs", "jobs") + """
SELECT job_id, CASE WHEN j.generation = d.generation AND (d.deleted_at IS NULL OR j.operation = 'REMOVE') THEN 'CURRENT' ELSE 'SUPERSEDED' END AS outcome
FROM jobs j LEFT JOIN docs d USING (document_id)""")
def fence(t: Tables):
    return lifecycle.generation_fence(x.jobs(t), x.docs(t)).select("job_id", "outcome")


@query("index_plan", """
SELECT doc_id AS document_id FROM documents WHERE lang <> 'de'""")
def index_plan(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("index_hash"))
    stored = t.documents.select(F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "de", F.sha2("text", 256)).otherwise(
        F.lit("old")).alias("index_hash"))
    return ch.plan_index(docs, stored).select("document_id")
