"""Statement candidates bound to source blocks, projected to facts and checked by a second reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.text import contains_command, count_occurrences, fold_case, quoted, span_text
from foliarc.operators.chunks import pack_batches

FIELDS = ["kind", "subject", "assertion", "medication_state", "temporality"]
KEY = ["block_id", "name", "source_text", *FIELDS]


def plan_blocks(blocks: DataFrame, block_limit: int | None = None, block_chars: int | None = None,
                context_chars: int | None = None) -> DataFrame:
    """Paragraph blocks with reading order, eligibility, batch number and preceding context.

    Every paragraph takes part, however many or long, unless a limit is given; :func:`block_issues`
    lists those that a limit leaves out.
    """
    within = F.lit(True)
    if block_limit is not None:
        within &= F.col("paragraph") <= block_limit
    if block_chars is not None:
        within &= F.length("text") <= block_chars
    order = W.partitionBy("document_id").orderBy("block_order")
    paragraphs = with_previous(blocks.filter("kind = 'paragraph'"), ["document_id"], "block_order", context_chars).select(
        "document_id", "block_order", "block_id", "page_index", "start_byte", "end_byte", "text", "previous", "previous_cut").withColumn(
        "paragraph", F.row_number().over(order))
    checked = paragraphs.withColumn(
        "eligible", within & ~contains_command(F.col("text")))
    batched = pack_batches(checked.filter("eligible").select("document_id", "block_order", F.length("text").alias("n")),
                           ["document_id"], ["block_order"], F.col("n").cast("bigint"), vocab.BLOCKS_PER_BATCH,
                           vocab.BLOCK_CHARS).select("document_id", "block_order", "batch")
    joined = checked.join(batched, ["document_id", "block_order"], "left")
    first = W.partitionBy("document_id", "batch").orderBy("block_order")
    return joined.withColumn("context_before", F.when(F.col("eligible"), F.first("previous").over(first))).withColumn(
        "context_cut", F.when(F.col("eligible"), F.first("previous_cut").over(first))).drop("previous", "previous_cut")


def with_previous(rows: DataFrame, keys: list[str], order: str, chars: int | None = None) -> DataFrame:
    """Adds ``previous``, the text of the row before ('' at the first), and ``previous_cut``.

    Without ``chars`` it is whole; with it the last so many characters are kept and ``previous_cut`` tells
    where some were left out.
    """
    before = F.lag("text", 1, "").over(W.partitionBy(*keys).orderBy(order))
    cut = F.lit(False) if chars is None else F.coalesce(F.length(before) > chars, F.lit(False))
    return rows.withColumn("previous", before if chars is None else F.right(before, F.lit(chars))).withColumn("previous_cut", cut)


def block_issues(planned: DataFrame, block_limit: int | None = None) -> DataFrame:
    """UNSUPPORTED_BLOCK for skipped paragraphs and BLOCK_LIMIT for each one beyond ``block_limit``."""
    over = F.lit(False) if block_limit is None else F.col("paragraph") > block_limit
    code = F.when(over, F.lit("BLOCK_LIMIT")).otherwise(F.lit("UNSUPPORTED_BLOCK"))
    return planned.filter(~F.col("eligible")).select("document_id", code.alias("code"), "block_id")


def _beyond(place: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else place > limit


def _fields_valid() -> Column:
    medication = F.col("kind") == "MEDICATION"
    known = (F.col("kind").isin(vocab.STATEMENT_KINDS) & F.col("subject").isin(vocab.SUBJECTS)
             & F.col("assertion").isin(vocab.ASSERTIONS) & F.col("medication_state").isin(vocab.MEDICATION_STATES)
             & F.col("temporality").isin(vocab.TEMPORALITIES) & F.length("name").between(1, 200)
             & F.length("source_text").between(1, 3000))
    consistent = F.when(medication, (F.col("assertion") == "UNKNOWN") & (F.col("medication_state") != "NOT_APPLICABLE")
                        ).otherwise(F.col("medication_state") == "NOT_APPLICABLE")
    return F.coalesce(known & consistent, F.lit(False))


def _source_name() -> Column:
    """The name as the quote spells it: a unique occurrence may differ in case only."""
    found = F.call_function("regexp_extract_all", F.col("source_text"),
                            F.concat(F.lit("(?iu)"), quoted(F.col("name"))), F.lit(0))
    return F.when(F.contains("source_text", F.col("name")), F.col("name")).when(
        F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.col("name"))


def _locate(joined: DataFrame) -> DataFrame:
    """Bind rows that carry their block (block_text, block_page, block_start, block_end)."""
    named = joined.withColumn("name", _source_name())
    unique = ((count_occurrences(F.col("block_text"), F.col("source_text")) == 1)
              & F.contains("source_text", F.col("name")) & ~contains_command(F.col("block_text")))
    prefix = F.substring(F.col("block_text"), F.lit(1),
                         F.call_function("locate", F.col("source_text"), F.col("block_text")) - 1)
    start = F.col("block_start") + F.octet_length(prefix)
    return named.withColumn("bound", F.coalesce(unique, F.lit(False)) & _fields_valid()).withColumn(
        "start_byte", F.when(F.col("bound"), start)).withColumn(
        "end_byte", F.when(F.col("bound"), start + F.octet_length("source_text")))


def _with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    side = blocks.select("document_id", "block_id", F.col("text").alias("block_text"),
                         F.col("page_index").alias("block_page"), F.col("start_byte").alias("block_start"),
                         F.col("end_byte").alias("block_end"), "eligible", F.col("batch").alias("block_batch"))
    return rows.join(side, ["document_id", "block_id"], "left")


def bind_statements(candidates: DataFrame, planned: DataFrame, statement_limit: int | None = None,
                    block_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, issues). Statements beyond ``statement_limit``, if one is given, become issues.

    ``candidates``: document_id, ord, block_id, name, the five fields, source_text, optional batch.
    ``planned``: :func:`plan_blocks`. A candidate is kept when its quote occurs once in its block,
    the quote holds its name and its fields agree.
    """
    joined = _with_block(candidates, planned)
    inside = F.coalesce("eligible", F.lit(False))
    if "batch" in candidates.columns:
        inside = inside & (F.col("batch") == F.col("block_batch"))
    located = _locate(joined).withColumn("bound", F.col("bound") & inside)
    key = W.partitionBy("document_id", *KEY, "bound").orderBy("ord")
    document = W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    ranked = located.withColumn("copy", F.row_number().over(key))
    fresh = F.col("bound") & (F.col("copy") == 1)
    ranked = ranked.withColumn("place", F.sum(fresh.cast("int")).over(document))
    verdict = (F.when(~F.col("bound"), F.lit("REJECTED_CANDIDATE")).when(F.col("copy") > 1, F.lit("DUPLICATE"))
               .when(_beyond(F.col("place"), statement_limit), F.lit("STATEMENT_LIMIT")))
    ranked = ranked.withColumn("code", verdict)
    statements = ranked.filter(F.col("code").isNull()).select(
        "document_id", (F.col("place") - 1).cast("int").alias("statement_index"), "block_id", "name", *FIELDS,
        "source_text", F.col("block_page").alias("page_index"), F.col("start_byte").cast("int").alias("start_byte"),
        F.col("end_byte").cast("int").alias("end_byte"), F.col("block_start").alias("context_start"),
        F.col("block_end").alias("context_end"), F.col("block_text").alias("context_text"))
    issues = ranked.filter(F.col("code").isNotNull()).select(
        "document_id", "code", F.when(inside, F.col("block_id")).alias("block_id"))
    if "batch" in candidates.columns:
        full = candidates.groupBy("document_id", "batch").agg(F.count(F.lit(1)).alias("n")).filter("n = 8")
        first = planned.filter("eligible").groupBy("document_id", "batch").agg(
            F.min_by("block_id", "block_order").alias("block_id"))
        issues = issues.unionByName(full.join(first, ["document_id", "batch"]).select(
            "document_id", F.lit("OUTPUT_LIMIT").alias("code"), "block_id"))
    return statements, issues.unionByName(block_issues(planned, block_limit))


def projected_status() -> Column:
    """Status in the fact vocabulary; never promotes another person's, past or unconfirmed statements."""
    state = F.col("medication_state")
    return (
        F.when((F.col("subject") != "PATIENT") | (F.col("temporality") != "CURRENT"), F.lit("UNKNOWN"))
        .when(F.col("kind") == "MEDICATION", F.when(state == "TAKING", F.lit("CONFIRMED"))
              .when(state == "PRESCRIBED", F.lit("PRESCRIBED")).otherwise(F.lit("UNKNOWN")))
        .when(F.col("assertion").isin("CONFIRMED", "SUSPECTED", "NEGATED"), F.col("assertion"))
        .otherwise(F.lit("UNKNOWN")))


def project_statements(statements: DataFrame, verifications: DataFrame | None = None) -> DataFrame:
    """Statements as facts; with verdicts, anything but agreement becomes an unknown observation."""
    facts = statements.select(
        "document_id", "statement_index",
        F.when(F.col("subject") == "PATIENT", F.col("kind")).otherwise(F.lit("OBSERVATION")).alias("type"), "name",
        F.col("context_text").alias("value_text"), projected_status().alias("assertion_status"), "page_index",
        F.col("context_text").alias("source_text"))
    if verifications is None:
        return facts
    verdicts = verifications.select("document_id", "statement_index", F.col("status").alias("_status"))
    agreed = F.coalesce(F.col("_status") == "AGREES", F.lit(False))
    return facts.join(verdicts, ["document_id", "statement_index"], "left").withColumn(
        "type", F.when(agreed, F.col("type")).otherwise(F.lit("OBSERVATION"))).withColumn(
        "assertion_status", F.when(agreed, F.col("assertion_status")).otherwise(F.lit("UNKNOWN"))).drop("_status")


def review_batches(statements: DataFrame) -> DataFrame:
    """Targets of one block in groups of four."""
    order = W.partitionBy("document_id", "block_id").orderBy("statement_index")
    return statements.withColumn(
        "review_batch", F.floor((F.row_number().over(order) - 1) / vocab.REVIEW_BATCH).cast("int"))


def review_statements(statements: DataFrame, second: DataFrame, planned: DataFrame) -> DataFrame:
    """document_id, statement_index, status, reason of an independent second reading.

    ``second``: document_id, statement_index, interpretation (struct of block_id, name, the five
    fields, source_text; NULL when the reader could not tell). A group of four with a missing or
    repeated answer is invalid as a whole.
    """
    answers = second.groupBy("document_id", "statement_index").agg(
        F.count(F.lit(1)).alias("answers"), F.first("interpretation").alias("i"))
    targets = review_batches(statements).join(answers, ["document_id", "statement_index"], "left")
    group = W.partitionBy("document_id", "block_id", "review_batch")
    targets = targets.withColumn("valid", F.min((F.coalesce("answers", F.lit(0)) == 1).cast("int")).over(group) == 1)
    original = targets.select(
        "document_id", "statement_index", "valid", F.col("i").isNotNull().alias("answered"),
        F.struct("block_id", "name", *FIELDS, "page_index", "start_byte", "end_byte").alias("o"), "i.*")
    located = _locate(_with_block(original, planned))
    same_target = (F.col("block_id") == F.col("o.block_id")) & (fold_case(F.col("name")) == fold_case(F.col("o.name")))
    keeps_anchor = ((F.col("block_page") == F.col("o.page_index")) & (F.col("start_byte") <= F.col("o.start_byte"))
                    & (F.col("end_byte") >= F.col("o.end_byte")))
    evidence = F.coalesce(F.col("bound") & same_target & keeps_anchor, F.lit(False))
    agrees = F.lit(True)
    for field in FIELDS:
        agrees = agrees & (F.col(field) == F.col(f"o.{field}"))
    status = (F.when(~F.col("valid"), F.lit("UNRESOLVED")).when(~F.col("answered"), F.lit("UNRESOLVED"))
              .when(~evidence, F.lit("UNRESOLVED")).when(agrees, F.lit("AGREES")).otherwise(F.lit("DISAGREES")))
    reason = (F.when(~F.col("valid"), F.lit("INVALID_RESPONSE")).when(~F.col("answered"), F.lit("INSUFFICIENT_EVIDENCE"))
              .when(~evidence, F.lit("INVALID_EVIDENCE")).when(agrees, F.lit("MATCH"))
              .otherwise(F.lit("SEMANTIC_DISAGREEMENT")))
    return located.select("document_id", "statement_index", status.alias("status"), reason.alias("reason"))


def validate_statements(statements: DataFrame, planned: DataFrame, docs: DataFrame, facts: DataFrame,
                        verifications: DataFrame | None = None, statement_limit: int | None = None) -> DataFrame:
    """document_id, statement_index, code for every broken rule of stored statements."""
    joined = _with_block(statements.withColumnRenamed("start_byte", "stored_start").withColumnRenamed(
        "end_byte", "stored_end"), planned).join(docs.select("document_id", "pages"), "document_id")
    located = _locate(joined)
    page = F.get("pages", F.col("page_index"))["text"]
    copies = W.partitionBy("document_id", *KEY)
    expected = project_statements(statements, verifications).select(
        "document_id", "statement_index", F.struct("type", "name", "value_text", "assertion_status", "source_text")
        .alias("expected"))
    stored = facts.select("document_id", "statement_index", F.struct(
        "type", "name", "value_text", "assertion_status", "source_text").alias("stored"))
    located = located.withColumn("copies", F.count(F.lit(1)).over(copies)).join(
        expected, ["document_id", "statement_index"], "left").join(stored, ["document_id", "statement_index"], "left")
    rules = [
        ("BLOCK", F.col("eligible")), ("FIELDS", _fields_valid()), ("BOUND", F.col("bound")),
        ("CONTEXT", (F.col("context_text") == F.col("block_text")) & (F.col("context_start") == F.col("block_start"))
         & (F.col("context_end") == F.col("block_end"))),
        ("SPAN", (F.col("stored_start") == F.col("start_byte")) & (F.col("stored_end") == F.col("end_byte"))
         & (span_text(page, F.col("stored_start"), F.col("stored_end")) == F.col("source_text"))),
        ("DUPLICATE", F.col("copies") == 1), ("LIMIT", ~_beyond(F.col("statement_index") + 1, statement_limit)),
        ("PROJECTION", F.col("stored") == F.col("expected"))]
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    found = located.select("document_id", "statement_index", F.explode(codes).alias("code"))
    if verifications is None:
        return found
    unresolved = ["INVALID_EVIDENCE", "INSUFFICIENT_EVIDENCE", "INVALID_RESPONSE"]
    verdict_ok = (((F.col("status") == "AGREES") & (F.col("reason") == "MATCH"))
                  | ((F.col("status") == "DISAGREES") & (F.col("reason") == "SEMANTIC_DISAGREEMENT"))
                  | ((F.col("status") == "UNRESOLVED") & F.col("reason").isin(unresolved)))
    bad = verifications.filter(~F.coalesce(verdict_ok, F.lit(False))).select(
        "document_id", "statement_index", F.lit("VERDICT").alias("code"))
    missing = statements.join(verifications, ["document_id", "statement_index"], "left_anti").select(
        "document_id", "statement_index", F.lit("NO_VERDICT").alias("code"))
    return found.unionByName(bad).unionByName(missing)
