"""Sinks: changes of the chunk index, audit trail, reports, gated exports and reference tables.

The stored index itself, its buckets and snapshots, is :mod:`foliarc.sources.index_store`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.session import durable
from foliarc.sources.index_store import change_index, index_buckets, read_index, vacuum, write_index

__all__ = ["append_absent", "append_audit", "append_references", "index_buckets", "prune_index", "prune_superseded", "read_index", "reconcile_ids",
           "remove_documents", "remove_from_index", "replace_documents", "upsert_chunks", "vacuum", "write_exports", "write_index", "write_report"]


# ---- next content ------------------------------------------------------------------------
def upsert_chunks(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with every key of ``fresh`` replaced; keys compare NULL-safely."""
    touched = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return stored.join(touched, same, "left_anti").unionByName(fresh)


def prune_superseded(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Only the kept revision of every named document stays; other documents are untouched."""
    joined = chunks.join(keep.select("document_id", "keep_revision_id"), "document_id", "left")
    stays = F.col("keep_revision_id").isNull() | F.col("revision_id").eqNullSafe(F.col("keep_revision_id"))
    return joined.filter(stays).drop("keep_revision_id")


def remove_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def reconcile_ids(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """chunk_id, action: insert what is missing, remove what is extra, keep the rest."""
    left = wanted.select("chunk_id", F.lit(True).alias("_w"))
    right = stored.select("chunk_id", F.lit(True).alias("_s"))
    action = F.when(F.col("_s").isNull(), F.lit("insert")).when(F.col("_w").isNull(), F.lit("remove")).otherwise(F.lit("keep"))
    return left.join(right, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


# ---- writers -----------------------------------------------------------------------------
def replace_documents(path: str, fresh: DataFrame, keys: list[str]) -> None:
    """Upsert ``fresh`` into a written index: only its buckets are written anew, in one snapshot."""
    incoming = durable(fresh)
    change_index(fresh.sparkSession, path, incoming, lambda stored: upsert_chunks(stored, incoming.select(*stored.columns), keys), incoming)


def prune_index(path: str, keep: DataFrame) -> None:
    """Drop superseded chunks (:func:`prune_superseded`) from a written index."""
    change_index(keep.sparkSession, path, keep, lambda stored: prune_superseded(stored, keep))


def remove_from_index(path: str, ids: DataFrame) -> None:
    """Remove documents from a written index."""
    change_index(ids.sparkSession, path, ids, lambda stored: remove_documents(stored, ids))


def append_audit(events: DataFrame, path: str) -> None:
    """Append-only audit trail, partitioned by day."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Replace a JSON report; readers see the old one until the job commits."""
    report.write.mode("overwrite").json(path)


def write_exports(gated: DataFrame, path: str) -> None:
    """Write the content that passed the export gate, one row per consultation."""
    gated.filter(F.col("code").isNull()).select("consultation_id", "content").write.mode("overwrite").json(path)


def append_references(references: DataFrame, path: str) -> None:
    references.write.mode("append").parquet(path)


def append_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Insert-if-absent into an append-only dataset."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    try:
        stored = spark.read.parquet(path).select(*keys)
    except Exception as exc:  # first write: the folder is not there yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = None
    if stored is not None:
        fresh = fresh.join(stored, keys, "left_anti")
    fresh.write.mode("append").parquet(path)
