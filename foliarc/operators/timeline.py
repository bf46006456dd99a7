"""Timeline, audit history and dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.operators.catalogue import fact_description


def live(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("deleted_at").isNull())


def rebuild_timeline(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """One event per document and one per active fact that was not rejected."""
    of_documents = docs.select(
        "document_id", F.lit(None).cast("string").alias("fact_id"), F.col("document_type").alias("event_type"),
        F.col("document_date").alias("event_date"), "title", F.col("summary").alias("description"))
    of_facts = facts.filter(F.col("active") & (F.col("review_status") != "REJECTED")).select(
        "document_id", "fact_id", F.col("type").alias("event_type"), "event_date", F.col("name").alias("title"),
        fact_description(F.col("value_text"), F.col("value_number"), F.col("unit")).alias("description"))
    return of_documents.unionByName(of_facts)


def timeline_query(timeline: DataFrame, docs: DataFrame, *, type: str | None = None, document_id=None,
                   date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Events of live documents, filtered before the join."""
    if type:
        timeline = timeline.filter(F.col("event_type") == type)
    if document_id is not None:
        timeline = timeline.filter(F.col("document_id") == document_id)
    if date_from:
        timeline = timeline.filter(F.col("event_date") >= F.lit(date_from).cast("date"))
    if date_to:
        timeline = timeline.filter(F.col("event_date") <= F.lit(date_to).cast("date"))
    titles = live(docs).select("document_id", F.col("title").alias("document_title"))
    return timeline.join(titles, "document_id", "inner")


def timeline_view(timeline: DataFrame, docs: DataFrame, versions: DataFrame, **filters) -> DataFrame:
    """Timeline rows with the document title and whether they come from an earlier text."""
    flags = versions.select("document_id", F.coalesce(
        F.col("facts_version") != F.col("text_version"), F.lit(False)).alias("earlier_text"))
    return timeline_query(timeline, docs, **filters).join(flags, "document_id", "left").withColumn(
        "earlier_text", F.coalesce("earlier_text", F.lit(False)))


def timeline_order() -> list[Column]:
    return [F.desc_nulls_last("event_date"), F.asc("document_id"), F.asc_nulls_first("fact_id")]


HISTORY_ORDER = [("created_at", False), ("audit_id", False)]


def history(audit: DataFrame, document_id=None) -> DataFrame:
    """Audit events, newest first."""
    rows = audit if document_id is None else audit.filter(F.col("document_id") == document_id)
    return rows.orderBy(F.desc("created_at"), F.desc("audit_id"))


def by_type(docs: DataFrame) -> DataFrame:
    return live(docs).groupBy(F.col("document_type").alias("type")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), "type")


def by_status(docs: DataFrame) -> DataFrame:
    return live(docs).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def over_time(docs: DataFrame) -> DataFrame:
    dated = live(docs).filter(F.col("document_date").isNotNull())
    return dated.groupBy(F.date_format("document_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("count")).orderBy("month")


def monthly_tail(months: DataFrame, size: int = 12) -> DataFrame:
    return months.orderBy(F.desc("month")).limit(size)


def live_counts(docs: DataFrame, facts: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row: facts and events of live documents."""
    ids = live(docs).select("document_id")
    shown = facts.filter(F.col("active") & (F.col("review_status") != "REJECTED"))
    rows = shown.join(ids, "document_id", "left_semi").select(F.lit("f").alias("kind")).unionByName(
        timeline.join(ids, "document_id", "left_semi").select(F.lit("e").alias("kind")))
    return rows.agg(F.count_if(F.col("kind") == "f").alias("facts"), F.count_if(F.col("kind") == "e").alias("events"))


def kpis(docs: DataFrame) -> DataFrame:
    status = F.col("status")
    return live(docs).agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if(status == "READY").alias("processed_documents"),
        F.count_if(status.isin(vocab.FAILED_STATUSES)).alias("failed_documents"),
        F.count_if(status.isin(vocab.PENDING_STATUSES)).alias("pending_documents"))


def recent_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    return live(docs).orderBy(F.desc("created_at"), "document_id").limit(size)


def recent_changes(audit: DataFrame, size: int = 8) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(size)


def dashboard(docs: DataFrame, facts: DataFrame, timeline: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's independent result tables."""
    return {"kpis": kpis(docs), "counts": live_counts(docs, facts, timeline), "by_type": by_type(docs),
            "by_status": by_status(docs), "over_time": over_time(docs),
            "recent_documents": recent_documents(docs), "recent_changes": recent_changes(audit)}


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based position inside a key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
