"""Registration, edits, revision activation, deletion and purge as whole-table projections.

Nothing is updated in place: every operator returns the next version of its tables, which the
caller writes as a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.hashing import canonical_hash, canonical_json, content_hash
from foliarc.functions.text import collapse, fold_case, span_text, strip
from foliarc.operators import catalogue as cat
from foliarc.operators.timeline import rebuild_timeline


# ---- registration ------------------------------------------------------------------------
def register_documents(incoming: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """documents, revisions, jobs, audit and conflicts of new notes.

    ``incoming``: document_id, title, document_type, document_date, text, tags, created_at;
    ``stored``: sha256, deleted_at. Content equal to a live document, or to an earlier row of the
    same batch, is a conflict.
    """
    rows = incoming.withColumn("sha256", content_hash(F.col("text")))
    first = rows.groupBy("sha256").agg(F.min("document_id").alias("document_id"))
    fresh = first.join(stored.filter(F.col("deleted_at").isNull()).select("sha256"), "sha256", "left_anti")
    accepted = rows.join(fresh.select("document_id"), "document_id", "left_semi")
    documents = accepted.select(
        "document_id", strip(F.col("title")).alias("title"), "document_type", "document_date",
        F.lit("TEXT").alias("source_type"), "sha256", F.lit("UPLOADED").alias("status"),
        cat.normalize_tags(F.col("tags")).alias("tags"), F.lit(1).alias("text_version"), F.lit(1).alias("generation"),
        F.concat_ws("\n", "title", "text").alias("search_text"), "created_at")
    return {
        "documents": documents,
        "revisions": accepted.select("document_id", F.lit(1).alias("version"), F.col("text").alias("content"),
                                     F.lit("user-text").alias("parser")),
        "jobs": accepted.select("document_id", F.lit("PROCESS").alias("operation"), F.lit(1).alias("generation"),
                                F.lit("QUEUED").alias("status")),
        "audit": accepted.select("document_id", F.lit("DOCUMENT_CREATED").alias("action")),
        "conflicts": rows.join(fresh.select("document_id"), "document_id", "left_anti").select("document_id", "sha256")}


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: incoming keys that are not stored, one row per key."""
    fresh = incoming.dropDuplicates(keys)
    return fresh.join(stored.select(*keys), keys, "left_anti")


# ---- activation --------------------------------------------------------------------------
def _identity(type_: Column, name: Column, date: Column) -> Column:
    return F.struct(type_.alias("type"), fold_case(collapse(name)).alias("name"), date.alias("date"))


def _known_to_review(preserved: DataFrame) -> DataFrame:
    """Both identities of every preserved fact, each once: _doc, _type, _name, _date, _known."""
    return preserved.select("document_id", F.explode(F.array(
        _identity(F.col("type"), F.col("name"), F.col("event_date")),
        _identity(F.col("original.type"), F.col("original.name"), F.col("original.event_date")))).alias("_i")).select(
        F.col("document_id").alias("_doc"), F.col("_i.type").alias("_type"), F.col("_i.name").alias("_name"),
        F.col("_i.date").alias("_date")).distinct().withColumn("_known", F.lit(True))


def _same_finding() -> Column:
    name = fold_case(collapse(F.col("name")))
    return ((F.col("document_id") == F.col("_doc")) & (F.col("type") == F.col("_type")) & (name == F.col("_name"))
            & F.col("event_date").eqNullSafe(F.col("_date")))


def suppressed_by_review(incoming: DataFrame, preserved: DataFrame) -> DataFrame:
    """Incoming facts that no preserved fact matches by its current or original type, name and date.

    Both identities of a preserved fact are exploded, so the disjunction is one equi-join.
    """
    return incoming.join(_known_to_review(preserved), _same_finding(), "left_anti")


def activate_revisions(prepared: DataFrame, facts: DataFrame, docs: DataFrame, revisions: DataFrame,
                       extractions: DataFrame, manifests: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, facts, revisions, timeline, tags and audit after the prepared revisions became active.

    ``prepared``: document_id, revision_id. ``facts`` carry revision_id, active, review_status.
    ``extractions``: revision_id, document_type, document_date, summary, tags, content. Reviewed
    facts stay; unreviewed active ones retire; incoming duplicates of reviewed facts stay inactive.
    ``timeline`` replaces the events of the switched documents, ``tags`` names the tags they need, and
    ``audit`` has one row per switched document. ``manifests`` (revision_id, index_manifest as
    struct with document_chunks) is kept on the active revision.
    """
    switching = prepared.select("document_id", F.col("revision_id").alias("_new"))
    tagged = facts.join(switching, "document_id", "left")
    arrives = F.col("revision_id").eqNullSafe(F.col("_new")) & F.col("_new").isNotNull()
    preserved = tagged.filter(F.col("_new").isNotNull() & F.col("active") & (F.col("review_status") != "UNREVIEWED"))
    # An incoming fact meets what review knows where it stands; nothing is joined back by fact.
    marked = tagged.join(_known_to_review(preserved), _same_finding() & arrives, "left").withColumn(
        "_visible", arrives & F.col("_known").isNull()).select(*tagged.columns, "_visible")
    next_active = (F.when(F.col("_new").isNull(), F.col("active"))
                   .when(F.col("_visible"), F.lit(True))
                   .when(F.col("active") & (F.col("review_status") == "UNREVIEWED"), F.lit(False))
                   .otherwise(F.col("active")))
    next_facts = marked.withColumn("active", next_active).drop("_new", "_visible")
    next_revisions = revisions.join(switching, "document_id", "left").withColumn("status", F.when(
        F.col("revision_id").eqNullSafe(F.col("_new")) & F.col("_new").isNotNull(), F.lit("ACTIVE")).when(
        F.col("_new").isNotNull() & (F.col("status") == "ACTIVE"), F.lit("SUPERSEDED")).otherwise(F.col("status"))).drop("_new")
    chunks = F.lit(None).cast("bigint")
    if manifests is not None:
        next_revisions = next_revisions.drop("index_manifest").join(manifests.select("revision_id", "index_manifest"), "revision_id", "left")
        chunks = F.col("index_manifest.document_chunks").cast("bigint")
    found = extractions.select(
        F.col("revision_id").alias("_new"), F.col("document_type").alias("x_type"), F.col("document_date").alias("x_date"),
        F.col("summary").alias("x_summary"), F.col("tags").alias("x_tags"), F.col("content").alias("x_content"))
    joined = docs.join(switching.join(found, "_new"), "document_id", "left")
    changed = F.col("_new").isNotNull()
    keep_type = F.col("document_type").isin(vocab.NOTE_TYPES)
    next_docs = joined.select(
        *[c for c in docs.columns if c not in ("document_type", "document_date", "summary", "tags", "search_text",
                                               "active_revision_id", "status")],
        F.when(changed & ~keep_type, F.col("x_type")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(changed, F.coalesce("document_date", "x_date")).otherwise(F.col("document_date")).alias("document_date"),
        F.when(changed, F.col("x_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(changed, cat.normalize_tags(F.concat("tags", "x_tags"))).otherwise(F.col("tags")).alias("tags"),
        F.when(changed, cat.search_text(F.col("title"), F.col("x_summary"), F.col("x_content")))
        .otherwise(F.col("search_text")).alias("search_text"),
        F.when(changed, F.col("_new")).otherwise(F.col("active_revision_id")).alias("active_revision_id"),
        F.when(changed, F.lit("READY")).otherwise(F.col("status")).alias("status"))
    switched = switching.select("document_id")
    own_docs = next_docs.join(switched, "document_id", "left_semi")
    timeline = rebuild_timeline(own_docs, next_facts.join(switched, "document_id", "left_semi"))
    tags = own_docs.select(F.explode("tags").alias("name")).distinct()
    counted = marked.filter(arrives).groupBy("document_id").agg(F.count_if("_visible").alias("facts"))
    noted = switching.withColumnRenamed("_new", "revision_id")
    if manifests is not None:
        noted = noted.join(manifests.select("revision_id", "index_manifest"), "revision_id", "left")
    audit = noted.join(counted, "document_id", "left").select(
        "document_id", F.lit("DOCUMENT").alias("entity_type"), F.col("document_id").alias("entity_id"),
        F.lit("PROCESSING_REVISION_ACTIVATED").alias("action"),
        F.struct("revision_id", F.coalesce("facts", F.lit(0)).alias("facts"), chunks.alias("chunks")).alias("after"))
    return {"documents": next_docs, "facts": next_facts, "revisions": next_revisions, "timeline": timeline, "tags": tags, "audit": audit}


# ---- edits -------------------------------------------------------------------------------
def follow_up(docs: DataFrame, jobs: DataFrame, runs: DataFrame, revisions: DataFrame) -> DataFrame:
    """document_id, operation: INDEX when the current text was fully extracted and activated, else PROCESS.

    ``runs``: document_id, run_id, status, text_version, created_at; ``revisions``: run_id, status.
    """
    pending = jobs.filter(F.col("operation").eqNullSafe("PROCESS") & F.col("status").isin("QUEUED", "RUNNING")).select(
        "document_id").distinct().withColumn("_pending", F.lit(True))
    newest = cat.latest_per(runs.select("document_id", "run_id", "created_at", F.col("status").alias("run_status"),
                                        F.col("text_version").alias("run_version")), ["document_id"], "created_at", "run_id",
                            ascending_tie=False)
    state = revisions.select("run_id", F.col("status").alias("revision_status")).dropDuplicates(["run_id"])
    joined = docs.select("document_id", "text_version").join(pending, "document_id", "left").join(
        newest, "document_id", "left").join(state, "run_id", "left")
    ready = ((F.col("text_version") > 0) & F.col("_pending").isNull() & (F.col("run_status") == "READY")
             & (F.col("run_version") == F.col("text_version"))
             & (F.col("revision_status").isNull() | (F.col("revision_status") == "ACTIVE")))
    return joined.select("document_id", F.when(F.coalesce(ready, F.lit(False)), F.lit("INDEX"))
                         .otherwise(F.lit("PROCESS")).alias("operation"))


def _moved(operation: Column) -> Column:
    return F.when(operation == "PROCESS", F.lit("UPLOADED")).otherwise(F.lit("INDEXING"))


def apply_document_edits(docs: DataFrame, edits: DataFrame, texts: DataFrame, operations: DataFrame) -> dict[str, DataFrame]:
    """documents, revisions, jobs after user edits; a NULL edit field leaves the value alone.

    ``edits``: document_id, title, document_type, document_date, summary, tags, text. A text edit is
    a new version to PROCESS; other edits follow ``operations`` (:func:`follow_up`).
    """
    names = ["title", "document_type", "document_date", "summary", "tags", "text"]
    side = edits.select("document_id", *[F.col(n).alias(f"e_{n}") for n in names], F.lit(True).alias("_edited"))
    content = texts.select("document_id", F.col("version").alias("text_version"), F.col("content").alias("_content"))
    joined = docs.join(side, "document_id", "left").join(content, ["document_id", "text_version"], "left").join(
        operations.select("document_id", F.col("operation").alias("_follow")), "document_id", "left")
    edited = F.coalesce("_edited", F.lit(False)) & F.col("deleted_at").isNull()
    new_text = edited & F.col("e_text").isNotNull()
    operation = F.when(new_text, F.lit("PROCESS")).otherwise(F.col("_follow"))
    value = {n: F.when(edited, F.coalesce(F.col(f"e_{n}"), F.col(n))).otherwise(F.col(n)) for n in names[:4]}
    value["tags"] = F.when(edited & F.col("e_tags").isNotNull(), cat.normalize_tags(F.col("e_tags"))).otherwise(F.col("tags"))
    value["text_version"] = F.col("text_version") + new_text.cast("int")
    value["sha256"] = F.when(new_text & (F.col("source_type") == "TEXT"), content_hash(F.col("e_text"))).otherwise(F.col("sha256"))
    value["generation"] = F.col("generation") + edited.cast("int")
    value["status"] = F.when(edited, _moved(operation)).otherwise(F.col("status"))
    value["search_text"] = F.when(edited, cat.search_text(
        value["title"], value["summary"], F.coalesce("e_text", "_content"))).otherwise(F.col("search_text"))
    documents = joined.select(*[value.get(c, F.col(c)).alias(c) for c in docs.columns])
    revisions = joined.filter(new_text).select("document_id", (F.col("text_version") + 1).alias("version"),
                                               F.col("e_text").alias("content"), F.lit("user-edit").alias("parser"))
    jobs = joined.filter(edited).select("document_id", operation.alias("operation"),
                                        (F.col("generation") + 1).alias("generation"))
    return {"documents": documents, "revisions": revisions, "jobs": jobs}


def correct_facts(facts: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """facts and history after edits of active facts.

    ``edits``: fact_id and the eight reviewed fields; NULL leaves a value alone. A changed value is
    always the user's correction unless the fact is rejected.
    """
    names = [*cat.FACT_VALUE_FIELDS, "review_status"]
    side = edits.select("fact_id", *[F.col(n).alias(f"e_{n}") for n in names], F.lit(True).alias("_edited"))
    joined = facts.join(side, "fact_id", "left").withColumn(
        "_on", F.coalesce("_edited", F.lit(False)) & F.col("active"))
    joined = joined.withColumn("_before", cat.fact_snapshot())
    for n in names:
        joined = joined.withColumn(n, F.when(F.col("_on"), F.coalesce(F.col(f"e_{n}"), F.col(n))).otherwise(F.col(n)))
    overridden = F.col("e_review_status").isNull() | (
        (F.col("review_status") != "REJECTED") & cat.differs_from_source())
    joined = joined.withColumn("review_status", F.when(F.col("_on") & overridden, F.lit("CORRECTED"))
                               .otherwise(F.col("review_status")))
    history = joined.filter("_on").select("fact_id", "document_id", F.col("_before").alias("old_value"),
                                          cat.fact_snapshot().alias("new_value"), F.col("review_status").alias("change_type"))
    return {"facts": joined.select(*facts.columns), "history": history}


def soft_delete(docs: DataFrame, ids: DataFrame, at: Column) -> dict[str, DataFrame]:
    """documents and REMOVE jobs; only live documents move."""
    marked = docs.join(ids.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    documents = marked.withColumn("_move", hit).withColumn(
        "deleted_at", F.when(F.col("_move"), at).otherwise(F.col("deleted_at"))).withColumn(
        "generation", F.col("generation") + F.col("_move").cast("int"))
    jobs = documents.filter("_move").select("document_id", F.lit("REMOVE").alias("operation"), "generation")
    return {"documents": documents.select(*docs.columns), "jobs": jobs}


def restore(docs: DataFrame, ids: DataFrame, operations: DataFrame) -> dict[str, DataFrame]:
    """documents and follow-up jobs of documents taken back from the trash."""
    marked = docs.join(ids.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left").join(
        operations.select("document_id", F.col("operation").alias("_follow")), "document_id", "left")
    marked = marked.withColumn("_move", F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNotNull())
    documents = marked.withColumn("deleted_at", F.when(~F.col("_move"), F.col("deleted_at"))).withColumn(
        "generation", F.col("generation") + F.col("_move").cast("int")).withColumn(
        "status", F.when(F.col("_move"), _moved(F.col("_follow"))).otherwise(F.col("status")))
    jobs = documents.filter("_move").select("document_id", F.col("_follow").alias("operation"), "generation")
    return {"documents": documents.select(*docs.columns), "jobs": jobs}


def reprocess_modes(docs: DataFrame, texts: DataFrame, parses: DataFrame) -> DataFrame:
    """document_id, modes: CURRENT_TEXT for an unpaged or already parsed text, ORIGINAL for a stored file.

    ``texts``: document_id, version, text_revision_id, page_count; ``parses``: text_revision_id, parse_recipe_hash.
    """
    stored = parses.filter(F.col("parse_recipe_hash").isNotNull()).select("text_revision_id").distinct().withColumn(
        "_parsed", F.lit(True))
    now = texts.select("document_id", F.col("version").alias("text_version"), "text_revision_id", "page_count").join(
        stored, "text_revision_id", "left")
    joined = docs.join(now, ["document_id", "text_version"], "left")
    current = F.col("text_revision_id").isNotNull() & ((F.col("page_count") == 0) | F.coalesce("_parsed", F.lit(False)))
    return joined.select("document_id", F.array_compact(F.array(
        F.when(current, F.lit("CURRENT_TEXT")), F.when(F.col("storage_path").isNotNull(), F.lit("ORIGINAL")))).alias("modes"))


def snapshot_unchanged(before: DataFrame, after: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, valid: every cited document kept its generation, text version and active revision."""
    keys = ["generation", "text_version", "active_revision_id"]
    now = after.select("document_id", F.struct(*keys).alias("_now"))
    then = before.select("document_id", F.struct(*keys).alias("_then"))
    stable = then.join(now, "document_id", "left").select(
        "document_id", F.coalesce(F.col("_then").eqNullSafe(F.col("_now")), F.lit(False)).alias("_ok"))
    return sources.join(stable, "document_id", "left").groupBy("answer_id").agg(
        F.bool_and(F.coalesce("_ok", F.lit(False))).alias("valid"))


def generation_fence(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events with their outcome: SUPERSEDED unless the generation is the document's current one."""
    now = docs.select("document_id", F.col("generation").alias("_generation"), F.col("deleted_at").alias("_deleted"))
    current = ((F.col("generation") == F.col("_generation"))
               & (F.col("_deleted").isNull() | (F.col("operation") == "REMOVE")))
    return events.join(now, "document_id", "left").withColumn("outcome", F.when(
        F.coalesce(current, F.lit(False)), F.lit("CURRENT")).otherwise(F.lit("SUPERSEDED"))).drop("_generation", "_deleted")


# ---- purge -------------------------------------------------------------------------------
def linked_consultations(consultations: DataFrame, prompts: DataFrame) -> DataFrame:
    """document_id, consultation_id of every consultation whose context or prompts name the document."""
    direct = consultations.select("consultation_id", F.explode("source_refs").alias("r"))
    through = prompts.select("consultation_id", F.explode("source_refs").alias("r"))
    return direct.unionByName(through).select(F.col("r.document_id").alias("document_id"), "consultation_id").distinct()


def purge_gate(requests: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """document_id, outcome: PURGE, or the reason of refusal.

    ``requests``: document_id, confirm_title, consultation_ids. The document must be in the trash,
    the title must match and the confirmed consultations must be exactly the linked ones.
    """
    asked = requests.select("document_id", F.explode(F.array_distinct("consultation_ids")).alias("consultation_id"))
    relevant = links.join(requests.select("document_id"), "document_id", "left_semi")
    sets = cat.sets_equal(relevant, asked, ["document_id"], "consultation_id")
    joined = requests.join(docs.select("document_id", "title", "deleted_at"), "document_id", "left").join(
        sets, "document_id", "left")
    outcome = (F.when(F.col("title").isNull(), F.lit("DOCUMENT_NOT_FOUND"))
               .when(F.col("deleted_at").isNull(), F.lit("DOCUMENT_NOT_IN_TRASH"))
               .when(F.col("confirm_title") != F.col("title"), F.lit("PURGE_NOT_CONFIRMED"))
               .when(~F.coalesce("same", F.lit(True)), F.lit("PURGE_CONSULTATIONS_CHANGED")).otherwise(F.lit("PURGE")))
    return joined.select("document_id", outcome.alias("outcome"))


def purge(tables: dict[str, DataFrame], ids: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Every table without the purged documents, their facts and their linked consultations.

    Tables with document_id, fact_id or consultation_id lose the matching rows; the audit table
    gains one anonymous row per document.
    """
    gone = ids.select("document_id").distinct()
    chats = links.join(gone, "document_id", "left_semi").select("consultation_id").distinct()
    facts = tables["facts"].join(gone, "document_id", "left_semi").select("fact_id") if "facts" in tables else None
    out = {}
    for name, df in tables.items():
        if "document_id" in df.columns:
            df = df.join(gone, "document_id", "left_anti")
        elif "fact_id" in df.columns and facts is not None:
            df = df.join(facts, "fact_id", "left_anti")
        if "consultation_id" in df.columns:
            df = df.join(chats, "consultation_id", "left_anti")
        out[name] = df
    counts = links.join(gone, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    out["purge_audit"] = gone.join(counts, "document_id", "left").select(
        F.col("document_id").cast("string").alias("entity_id"), F.lit("DOCUMENT_PURGED").alias("action"),
        F.coalesce("n", F.lit(0)).alias("consultations_deleted"))
    return out


def deletable_originals(purged: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """document_id, path of originals that may be deleted.

    A stored path is the document's own; without one, a PDF's file is found by its hash, but never
    when another document has the same hash or when the file is another document's.
    """
    own = purged.filter(F.col("storage_path").isNotNull()).select("document_id", F.col("storage_path").alias("path"))
    copies = docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("sha256")
    lost = purged.filter(F.col("storage_path").isNull() & (F.col("source_type") == "PDF") & F.col("sha256").isNotNull()).join(
        copies, "sha256", "left_semi")
    known = docs.filter(F.col("storage_path").isNotNull()).select(F.col("storage_path").alias("path"))
    found = files.select("path", "sha256").join(known, "path", "left_anti").join(
        lost.select("document_id", "sha256"), "sha256").select("document_id", "path")
    return own.unionByName(found)


# ---- detail ------------------------------------------------------------------------------
def document_detail(docs: DataFrame, facts: DataFrame, texts: DataFrame, jobs: DataFrame, runs: DataFrame,
                    revisions: DataFrame) -> DataFrame:
    """One row per document with nested facts and revisions, the latest job and run, and the current text."""
    fact_rows = facts.filter("active").groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("created_at", "fact_id", "type", "name"))).alias("facts"))
    versions = texts.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("version", "text_revision_id")), asc=False)
                                                .alias("text_revisions"))
    job = cat.latest_per(jobs.select("document_id", F.col("job_id").alias("latest_job"), F.col("created_at").alias("_j")),
                         ["document_id"], "_j", "latest_job", ascending_tie=False).drop("_j")
    run = cat.latest_per(runs.select("document_id", F.col("run_id").alias("latest_run"), F.col("created_at").alias("_r")),
                         ["document_id"], "_r", "latest_run", ascending_tie=False).drop("_r")
    active = revisions.filter("status = 'ACTIVE'").select(
        F.col("revision_id").alias("active_revision_id"), F.struct("revision_id", "text_revision_id").alias("active_revision"))
    none = F.array().cast(fact_rows.schema["facts"].dataType)
    return (cat.current_text(docs, texts).join(fact_rows, "document_id", "left").join(versions, "document_id", "left")
            .join(job, "document_id", "left").join(run, "document_id", "left").join(active, "active_revision_id", "left")
            .withColumn("facts", F.coalesce("facts", none)))


def build_recipes(docs: DataFrame, settings: dict[str, str | int | bool | None]) -> DataFrame:
    """document_id, recipe (JSON), recipe_hash: the versions and settings behind each document.

    ``docs``: document_id, parser_version, method (lab, visit, visit-review or legacy). Floats are
    refused: they print differently between languages.
    """
    if any(isinstance(v, float) for v in settings.values()):
        raise ValueError("RECIPE_FLOAT")

    def setting(name: str) -> Column:
        value = settings.get(name)
        return F.lit(value) if value is not None else F.lit(None).cast("string")

    method = F.col("method")
    lab = method == "lab"
    parse_fields = dict(normalizerVersion=F.lit(vocab.NORMALIZER_VERSION), parserVersion=F.col("parser_version"),
                        recipeVersion=F.lit(vocab.RECIPE_VERSION), sourceIRVersion=F.lit(vocab.IR_VERSION),
                        stage=F.lit("SOURCE_ONLY"))
    parse = _struct(parse_fields)
    rows = docs.withColumn("_parse_hash", canonical_hash(parse))
    annotation = _struct(dict(
        annotationVersion=F.when(lab, F.lit(vocab.LAB_VERSION)).when(method == "visit", F.lit(vocab.VISIT_VERSION))
        .when(method == "visit-review", F.lit(vocab.REVIEW_VERSION)),
        factSchemaVersion=F.lit(vocab.FACT_SCHEMA_VERSION),
        maxFactsPerBatch=F.when(method == "legacy", setting("max_facts_per_batch")),
        projectionVersion=F.when(lab, F.lit(vocab.LAB_PROJECTION_VERSION)),
        promptVersion=F.when(method == "visit", F.lit(vocab.VISIT_PROMPT_VERSION))
        .when(method == "visit-review", F.lit(vocab.REVIEW_PROMPT_VERSION)).when(method == "legacy", F.lit(vocab.PROMPT_VERSION))))
    index = _struct(dict(
        chunkOverlap=setting("chunk_overlap"), chunkSize=setting("chunk_size"), chunkerVersion=F.lit(vocab.SPLITTER_VERSION),
        embeddingDigest=setting("embedding_digest"), embeddingModel=setting("embedding_model")))
    body = _struct(dict(
        annotation=annotation, generationOptions=F.lit(None).cast("string"), index=index, method=method,
        model=F.when(~lab, setting("model")), modelDigest=F.when(~lab, setting("model_digest")),
        normalizerVersion=F.lit(vocab.NORMALIZER_VERSION),
        parse=_struct(parse_fields | {"recipeHash": F.col("_parse_hash")}), profile=setting("profile"),
        recipeVersion=F.lit(vocab.RECIPE_VERSION), sourceIRVersion=F.lit(vocab.IR_VERSION)))
    return rows.select("document_id", canonical_json(body).alias("recipe")).withColumn(
        "recipe_hash", F.sha2("recipe", 256))


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def recipe_key_subset(recipe: Column, keys: list[str]) -> Column:
    """Allow-listed keys of a recipe, absent ones left out."""
    parsed = F.from_json(recipe, "map<string,string>")
    return F.map_filter(parsed, lambda key, _: key.isin(keys))


def verify_artifact_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, code for stored spans that do not decode to their quote or name another source.

    ``spans``: document_id, page_index, start_byte, end_byte, source_text, ir_hash; ``docs``: document_id,
    pages, ir_hash.
    """
    joined = spans.join(docs.select("document_id", "pages", F.col("ir_hash").alias("_ir")), "document_id", "left")
    page = F.get("pages", F.col("page_index"))["text"]
    code = (F.when(~F.coalesce(F.col("ir_hash") == F.col("_ir"), F.lit(False)), F.lit("ARTIFACT_SOURCE_MISMATCH"))
            .when(~F.coalesce(span_text(page, F.col("start_byte"), F.col("end_byte")) == F.col("source_text"), F.lit(False)),
                  F.lit("ROW_SOURCE_MISMATCH")))
    return joined.withColumn("code", code).filter(F.col("code").isNotNull()).select("document_id", "start_byte", "code")
