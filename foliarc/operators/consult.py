"""Consultation packages: preparation, review, export, responses and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc.functions.hashing import content_hash
from foliarc.functions.text import non_blank
from foliarc.operators import catalogue as cat
from foliarc.operators.redact import redact
from foliarc.session import by_key, durable


def budget_prefix(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows taken in order until the first that would exceed the budget; a key's rows are bounded."""
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(window)).filter(F.col("_sum") <= budget).drop("_sum")


def prepare_consultations(requests: DataFrame, docs: DataFrame, texts: DataFrame, facts: DataFrame,
                          snippets: DataFrame, text_chars: int | None = None, budget: int | None = None,
                          max_documents: int | None = None) -> DataFrame:
    """consultation_id, content, content_hash, status, code, source_refs, warnings.

    ``requests``: consultation_id, question, document_ids (ordered); ``snippets``: consultation_id,
    document_id, ord, text (cited excerpts; without any that is not blank the text itself is used).
    READY live documents only; the package is redacted as a whole. Nothing is cut unless
    ``text_chars`` (of one document), ``budget`` (of all contexts) or ``max_documents`` is given,
    and ``warnings`` then lists each cut: DOCUMENT_TRUNCATED:<id> or DOCUMENT_OMITTED:<id>.
    """
    chosen = requests.select("consultation_id", "question", F.posexplode(F.array_distinct("document_ids")).alias(
        "place", "document_id"))
    ready = docs.filter(F.col("deleted_at").isNull() & (F.col("status") == "READY"))
    current = cat.current_text(ready, texts).select(
        "document_id", "document_date", "title", F.col("text_version").cast("int").alias("text_version"), "generation", "content")
    cited = snippets.groupBy("consultation_id", "document_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "\n").alias("cited"))
    number = cat.fact_description(F.lit(None).cast("string"), F.col("value_number"), F.lit(None).cast("string"))
    line = F.concat_ws(" ", F.concat(F.lit("USER "), F.col("review_status")), "name", "value_text",
                       F.when(F.col("value_number").isNotNull(), number), "unit")
    reviewed = facts.filter(cat.reviewed_context_eligible(F.col("active"), F.col("review_status"))).groupBy("document_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "fact_id", line.alias("line")))),
                                 lambda r: r["line"]), "\n").alias("reviewed"))
    joined = chosen.join(current, "document_id", "left").join(cited, ["consultation_id", "document_id"], "left").join(
        reviewed, "document_id", "left")
    text = F.when(F.coalesce(non_blank(F.col("cited")), F.lit(False)), F.col("cited")).otherwise(F.col("content"))
    shown = text if text_chars is None else F.substring(text, 1, text_chars)
    date = F.concat(F.lit("Medical date: "), F.coalesce(F.col("document_date").cast("string"), F.lit("unknown")))
    parts = F.filter(F.array(date, shown, F.col("reviewed")),
                     lambda p: p.isNotNull() & (p != ""))
    contexts = joined.withColumn("context", F.array_join(parts, "\n")).withColumn(
        "_bad", F.col("title").isNull() | ~F.coalesce(non_blank(text), F.lit(False))).withColumn(
        "_cut", F.coalesce(F.length(text) > F.length(shown), F.lit(False)))
    upto = F.sum(F.length("context")).over(W.partitionBy("consultation_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    contexts = contexts.withColumn("_kept", F.lit(True) if budget is None else upto <= budget)
    note = F.when(~F.col("_kept"), F.concat(F.lit("DOCUMENT_OMITTED:"), F.col("document_id").cast("string"))).when(
        F.col("_cut"), F.concat(F.lit("DOCUMENT_TRUNCATED:"), F.col("document_id").cast("string")))

    def listed(when: Column, value: Column) -> Column:
        """``value`` of the rows where ``when`` holds, by place."""
        return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("place", value.alias("v"))))), lambda r: r["v"])

    gathered = contexts.withColumn("_note", note).groupBy("consultation_id").agg(
        F.bool_or("_bad").alias("bad"), F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("place", "document_id", "title", "text_version", "generation"))).alias("source_refs"),
        listed(F.col("_note").isNotNull(), F.col("_note")).alias("warnings"), listed(F.col("_kept"), F.col("context")).alias("_contexts"))
    over = F.lit(False) if max_documents is None else F.col("n") > max_documents
    early = (F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("INSUFFICIENT_CONTEXT"))
             .when(over, F.lit("CONTEXT_LIMIT")).when(F.col("bad"), F.lit("SOURCE_UNAVAILABLE")))
    # A package that is refused for its sources shows no text: the rules run on the others only.
    asked = durable(requests.select("consultation_id", "question").join(gathered, "consultation_id", "left").withColumn(
        "_early", early).withColumn("_body", F.when(F.col("_early").isNull(), F.array_join("_contexts", "\n\n---\n\n"))).drop(
        "_contexts", "bad", "n"), "asked")
    packages = asked.filter(F.col("_early").isNull()).select(
        F.col("consultation_id").alias("package_id"), F.array(F.concat(
            F.lit("# Контекст для консультации\n\n## Вопрос\n\n"), F.col("question"), F.lit("\n\n## Данные архива\n\n"),
            F.coalesce("_body", F.lit("")))).alias("fields"), F.lit("").alias("identifier_context"))
    clean = redact(by_key(packages, "package_id")).select(
        F.col("package_id").alias("consultation_id"), F.get("texts", F.lit(0)).alias("text"), F.col("code").alias("privacy_code"))
    done = asked.join(clean, "consultation_id", "left")
    code = F.coalesce("_early", "privacy_code")
    return done.withColumn("code", code).withColumn(
        "content", F.when(F.col("code").isNull(), cat.export_safe(F.col("text")))).select(
        "consultation_id", "content", content_hash(F.col("content")).alias("content_hash"),
        F.when(F.col("code").isNull(), F.lit("NEEDS_REVIEW")).alias("status"), "code", "source_refs",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def edit_drafts(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """Drafts after edits: new safe content, new hash, review withdrawn."""
    side = edits.select("consultation_id", F.col("content").alias("_new"))
    joined = drafts.join(side, "consultation_id", "left")
    on = F.col("_new").isNotNull()
    content = F.when(on, cat.export_safe(F.col("_new"))).otherwise(F.col("content"))
    return joined.withColumn("content", content).withColumn(
        "content_hash", F.when(on, content_hash(F.col("content"))).otherwise(F.col("content_hash"))).withColumn(
        "reviewed_hash", F.when(~on, F.col("reviewed_hash"))).withColumn(
        "status", F.when(on, F.lit("NEEDS_REVIEW")).otherwise(F.col("status"))).drop("_new")


def review_drafts(drafts: DataFrame, reviews: DataFrame, prompts: DataFrame) -> dict[str, DataFrame]:
    """drafts, prompts (to append) and refused reviews; a review must name the current content hash."""
    side = reviews.select("consultation_id", F.col("content_hash").alias("_named"))
    joined = drafts.join(side, "consultation_id", "left")
    fits = F.coalesce((F.col("_named") == F.col("content_hash")) & (content_hash(F.col("content")) == F.col("_named")), F.lit(False))
    marked = joined.withColumn("_ok", fits)
    after = marked.withColumn("reviewed_hash", F.when(F.col("_ok"), F.col("_named")).otherwise(F.col("reviewed_hash"))).withColumn(
        "status", F.when(F.col("_ok"), F.lit("REVIEWED")).otherwise(F.col("status")))
    fresh = marked.filter("_ok").select("consultation_id", "content", "content_hash").join(
        prompts.select("consultation_id", "content_hash"), ["consultation_id", "content_hash"], "left_anti")
    refused = marked.filter(F.col("_named").isNotNull() & ~F.col("_ok")).select(
        "consultation_id", F.lit("CONTENT_CHANGED").alias("code"))
    return {"drafts": after.select(*drafts.columns), "prompts": fresh, "refused": refused}


def export_gate(drafts: DataFrame) -> DataFrame:
    """consultation_id, content, code: only reviewed, unchanged and safe content leaves."""
    reviewed = ((F.col("status") == "REVIEWED") & F.col("reviewed_hash").eqNullSafe(F.col("content_hash"))
                & (content_hash(F.col("content")) == F.col("content_hash")))
    code = F.when(~reviewed, F.lit("REVIEW_REQUIRED")).when(
        cat.export_safe(F.col("content")) != F.col("content"), F.lit("PRIVACY_CHECK_FAILED"))
    return drafts.withColumn("code", code).select(
        "consultation_id", F.when(F.col("code").isNull(), F.col("content")).alias("content"), "code")


def add_responses(incoming: DataFrame, stored: DataFrame, prompts: DataFrame) -> DataFrame:
    """response_id, outcome: CREATED, EXISTING, CONFLICT or PROMPT_VERSION_REQUIRED; repeats are harmless."""
    body = ["consultation_id", "prompt_id", "model", "content"]
    have = stored.select("response_id", F.struct(*body).alias("_have"))
    known = prompts.select("consultation_id", "prompt_id").distinct().withColumn("_prompt", F.lit(True))
    rows = incoming.withColumn("model", F.trim("model")).join(known, ["consultation_id", "prompt_id"], "left").join(
        have, "response_id", "left")
    same = F.struct(*body).eqNullSafe(F.col("_have"))
    outcome = (F.when(F.col("_prompt").isNull(), F.lit("PROMPT_VERSION_REQUIRED")).when(F.col("_have").isNull(), F.lit("CREATED"))
               .when(same, F.lit("EXISTING")).otherwise(F.lit("CONFLICT")))
    return rows.select("response_id", outcome.alias("outcome"))


def backfill_prompts(consultations: DataFrame) -> DataFrame:
    """One prompt per consultation whose reviewed hash is its content hash."""
    return consultations.filter(F.col("reviewed_hash") == F.col("content_hash")).select(
        "consultation_id", "content", "content_hash")


def list_consultations(consultations: DataFrame, responses: DataFrame, q: str | None = None) -> DataFrame:
    """List view: no content, source and response counts, newest first."""
    rows = consultations if not q else consultations.filter(cat.contains_literal(F.col("question"), q.strip()))
    counts = responses.groupBy("consultation_id").agg(F.count(F.lit(1)).alias("response_count"))
    return rows.join(counts, "consultation_id", "left").select(
        "consultation_id", "question", "status", "created_at", F.size("source_refs").alias("source_count"),
        F.coalesce("response_count", F.lit(0)).alias("response_count")).orderBy(F.desc("created_at"), F.desc("consultation_id"))


def consultation_detail(consultations: DataFrame, prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Consultations with their prompts and responses in creation order."""
    def nested(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy("consultation_id").agg(F.sort_array(F.collect_list(F.struct("created_at", key, "content"))).alias(name))

    return (consultations.join(nested(prompts, "prompt_id", "prompts"), "consultation_id", "left")
            .join(nested(responses, "response_id", "responses"), "consultation_id", "left"))
