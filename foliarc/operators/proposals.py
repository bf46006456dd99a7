"""Fact proposals checked against the pages they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.numbers import is_valid_date_or_null
from foliarc.functions.text import collapse, contains_command, non_blank
from foliarc.operators.catalogue import keep_first, violations
from foliarc.operators.chunks import pack_batches

PART_CHARS = 14000
BATCH_CHARS = 16000
MAX_FACTS_PER_BATCH = 8


def extraction_batches(pages: DataFrame) -> DataFrame:
    """document_id, page_number, part, batch: page parts packed into bounded batches."""
    count = F.greatest(F.ceil(F.length("text") / PART_CHARS), F.lit(1)).cast("int")
    parts = pages.filter(F.length("text") > 0).select(
        "document_id", "page_number", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"), F.col("text"))
    size = F.least(F.length("text") - F.col("part") * PART_CHARS, F.lit(PART_CHARS))
    rows = parts.select("document_id", "page_number", "part", size.cast("bigint").alias("size"))
    return pack_batches(rows, ["document_id"], ["page_number", "part"], F.col("size"), 2147483647, BATCH_CHARS)


def quote_on_page(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts with ``on_page``: the quote occurs, whitespace aside, on the page it claims (NULL page included)."""
    side = pages.select("document_id", F.col("page_number").alias("_page"), collapse(F.col("text")).alias("_text"))
    joined = facts.join(side, (facts.document_id == side.document_id) & F.col("page").eqNullSafe(F.col("_page")),
                        "left").drop(side.document_id)
    hit = F.coalesce(F.contains("_text", collapse(F.col("source_text"))), F.lit(False))
    keys = [c for c in facts.columns]
    return joined.groupBy(*keys).agg(F.bool_or(hit).alias("on_page"))


def verify_fact_proposals(facts: DataFrame, pages: DataFrame,
                          max_facts: int = MAX_FACTS_PER_BATCH) -> tuple[DataFrame, DataFrame]:
    """(accepted facts, warnings).

    ``facts``: document_id, batch, ord, type, name, page, source_text and value columns. A fact
    without its quote or quoting a command is rejected; repeats keep the first.
    """
    checked = quote_on_page(facts, pages).withColumn(
        "code", F.when(~F.col("on_page"), F.lit("QUOTE_REJECTED"))
        .when(contains_command(F.col("source_text")), F.lit("COMMAND_REJECTED")))
    accepted = keep_first(checked.filter(F.col("code").isNull()), ["document_id", "type", "name", "page", "source_text"], ["batch", "ord"]).drop(
        "copies", "code", "on_page")
    rejected = checked.filter(F.col("code").isNotNull()).groupBy("document_id", "batch", "code").agg(
        F.count(F.lit(1)).alias("facts"))
    full = facts.groupBy("document_id", "batch").agg(F.count(F.lit(1)).alias("facts")).filter(
        F.col("facts") >= max_facts).select("document_id", "batch", F.lit("FACT_LIMIT").alias("code"), "facts")
    return accepted, rejected.unionByName(full)


def reconcile_batches(batches: DataFrame, max_tags: int | None = None) -> DataFrame:
    """document_id, document_date, date_conflict, summary, tags of a document's batch outputs.

    ``batches``: document_id, batch, document_date, summary, tags. One distinct date survives;
    summaries and tags keep their first-seen order, all or the first ``max_tags`` of them.
    """
    rows = batches.groupBy("document_id").agg(
        F.min("document_date").alias("low"), F.max("document_date").alias("high"),
        F.sort_array(F.collect_list(F.struct("batch", "summary", "tags"))).alias("rows"))
    tags = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tags"])))
    return rows.select(
        "document_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("document_date"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("date_conflict"),
        F.array_join(F.array_distinct(F.transform("rows", lambda r: r["summary"])), "\n").alias("summary"),
        (tags if max_tags is None else F.slice(tags, 1, max_tags)).alias("tags"))


def fact_rules(text: Column, has_page: Column) -> list[tuple[str, Column]]:
    """Validity rules of one extracted fact against the document text."""
    def given(name: str, check: Column) -> Column:
        return F.col(name).isNull() | check

    number = F.col("value_number").cast("double")
    return [
        ("TYPE", F.col("type").isin(vocab.FACT_TYPES)), ("NAME", non_blank(F.col("name")) & (F.length("name") <= 300)),
        ("EVENT_DATE", is_valid_date_or_null(F.col("event_date").cast("string"))),
        ("ASSERTION_STATUS", F.coalesce("assertion_status", F.lit("UNKNOWN")).isin(vocab.ASSERTION_STATUSES)),
        ("VALUE_TEXT", given("value_text", F.length("value_text") <= 10000)),
        ("VALUE_NUMBER", given("value_number", ~F.isnan(number) & (F.abs(number) < float("inf")))),
        ("UNIT", given("unit", F.length("unit") <= 100)),
        ("CONFIDENCE", given("confidence", F.col("confidence").between(0, 1))),
        ("QUOTE", non_blank(F.col("source_text"))
         & F.contains(collapse(text), collapse(F.col("source_text")))),
        ("PAGE", F.col("page").isNull() | has_page)]


def validate_extraction(facts: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """document_id, ord, code for every broken rule; ``texts``: document_id, text."""
    located = quote_on_page(facts, pages).join(
        texts.select("document_id", F.col("text").alias("_text")), "document_id", "left")
    codes = violations(fact_rules(F.col("_text"), F.col("on_page")))
    return located.select("document_id", "ord", F.explode(codes).alias("code"))
