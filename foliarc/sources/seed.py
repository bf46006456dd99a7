"""Nested seed manifests: one record becomes document, revision, fact, provenance, history and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc.functions.hashing import content_hash
from foliarc.operators.catalogue import FACT_VALUE_FIELDS, normalize_tags, search_text

RECORD = """id string, title string, documentType string, documentDate date, sourceType string, text string,
pages array<struct<pageNumber:int,text:string>>, summary string, tags array<string>, originalFile string,
facts array<struct<type:string,name:string,valueText:string,valueNumber:double,unit:string,eventDate:date,
assertionStatus:string,confidence:double,provenance:struct<page:int,sourceText:string>,
correction:struct<valueText:string,valueNumber:double,unit:string>>>"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def seed_allowed(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row, allowed: the stored archive is empty or holds exactly seeds of this dataset.

    ``stored``: document_id, is_seed; ``incoming``: document_id.
    """
    ids = incoming.select("document_id").distinct().withColumn("_known", F.lit(True))
    joined = stored.join(ids, "document_id", "left")
    known = F.coalesce("_known", F.lit(False))
    counts = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_seed") & ~known).alias("foreign"),
                        F.count_if(F.col("is_seed") & known).alias("own"))
    return counts.select(((F.col("foreign") == 0) & ((F.col("n") == 0) | (F.col("own") > 0))).alias("allowed"))


def load_seed(records: DataFrame) -> dict[str, DataFrame]:
    """documents, revisions, facts, provenance, history, audit and jobs of seed records."""
    documents = records.select(
        F.col("id").alias("document_id"), "title", F.col("documentType").alias("document_type"),
        F.col("documentDate").alias("document_date"), F.col("sourceType").alias("source_type"), content_hash(F.col("text")).alias("sha256"),
        F.lit("INDEXING").alias("status"), "summary", normalize_tags(F.col("tags")).alias("tags"), F.lit(1).alias("text_version"),
        F.lit(1).alias("generation"), search_text(F.col("title"), F.col("summary"), F.col("text")).alias("search_text"),
        F.lit(True).alias("is_seed"))
    revisions = records.select(F.col("id").alias("document_id"), F.lit(1).alias("version"), F.col("text").alias("content"), "pages",
                               F.lit("synthetic-seed").alias("parser"))
    rows = records.select(F.col("id").alias("document_id"), F.posexplode("facts").alias("at", "f"))
    base = rows.select(
        F.concat_ws("#", "document_id", "at").alias("fact_id"), "document_id", F.col("f.type").alias("type"),
        F.col("f.name").alias("name"), F.col("f.valueText").alias("value_text"), F.col("f.valueNumber").alias("value_number"),
        F.col("f.unit").alias("unit"), F.col("f.eventDate").alias("event_date"),
        F.coalesce("f.assertionStatus", F.lit("UNKNOWN")).alias("assertion_status"), F.col("f.confidence").alias("confidence"),
        F.col("f.correction").alias("correction"), F.col("f.provenance").alias("provenance"))
    original = F.struct(*FACT_VALUE_FIELDS)
    corrected = F.col("correction").isNotNull()
    facts = base.withColumn("original", original)
    for name, source in (("value_text", "valueText"), ("value_number", "valueNumber"), ("unit", "unit")):
        facts = facts.withColumn(name, F.when(corrected, F.coalesce(F.col(f"correction.{source}"), F.col(name))).otherwise(F.col(name)))
    facts = facts.withColumn("review_status", F.when(corrected, F.lit("CORRECTED")).otherwise(F.lit("UNREVIEWED"))).withColumn(
        "active", F.lit(True))
    history = facts.filter(corrected).select("fact_id", F.col("original").alias("old_value"), F.struct(*FACT_VALUE_FIELDS).alias("new_value"),
                                             F.lit("CORRECTED").alias("change_type"))
    provenance = facts.select("fact_id", "document_id", F.lit(1).alias("text_version"), F.col("provenance.page").alias("page_number"),
                              F.coalesce("provenance.sourceText", F.lit("")).alias("source_text"))
    audit = documents.select("document_id", F.lit("SYNTHETIC_SEED_IMPORTED").alias("action")).unionByName(
        facts.filter(corrected).select("document_id", F.lit("FACT_CORRECTED").alias("action")))
    return {"documents": documents, "revisions": revisions, "facts": facts.drop("correction", "provenance"), "provenance": provenance,
            "history": history, "audit": audit,
            "jobs": documents.select("document_id", F.lit("INDEX").alias("operation"), F.lit(1).alias("generation"))}
