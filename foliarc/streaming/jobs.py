"""Structured Streaming jobs: document ingest, generation fencing and audit roll-up.

Every job takes a streaming DataFrame and a checkpoint folder; on a cluster both live in shared
storage. Micro-batches are written under their batch id, so a replay overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from foliarc import vocab
from foliarc.operators.chunks import document_chunks, with_index_hash
from foliarc.operators.lifecycle import generation_fence
from foliarc.session import durable
from foliarc.sources.index_store import change_index
from foliarc.sources.sinks import remove_documents

# Folder of the document state inside the output; readers of the output skip names with an underscore.
STATE = "_documents"


def document_events(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    """Stream of newly arrived Parquet files of document events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def suppress_duplicates(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events whose content hash was not seen within the watermark."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def latest_generation(events: DataFrame) -> DataFrame:
    """Streaming state: the newest generation of every document and its event (update or complete mode)."""
    row = F.struct("generation", "created_at", "sha256")
    return events.groupBy("document_id").agg(F.max_by(row, F.struct("generation", "created_at")).alias("latest")).select(
        "document_id", "latest.*")


def changed_documents(events: DataFrame, size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """Stream of the documents to chunk, ``pages`` as JSON: keyed state holds each document's version and index hash.

    A version below the stored one is refused, and a document whose text and settings are stored already is
    left out. A micro-batch reads and writes the state of its own documents only, whatever came before; with
    RocksDB as the session's state store provider that state lives on local disk instead of in memory.
    """
    hashed = with_index_hash(events.select("document_id", "title", F.coalesce("version", F.lit(0)).alias("version"), "text", "pages"), size=size, overlap=overlap)
    rows = hashed.select("document_id", "title", "version", "text", F.to_json("pages").alias("pages"), "index_hash")

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in frames:
            best = frame.loc[[frame["version"].idxmax()]]
            if newest is None or best["version"].iloc[0] > newest["version"].iloc[0]:
                newest = best
        version, digest = int(newest["version"].iloc[0]), newest["index_hash"].iloc[0]
        stored = state.get if state.exists else None
        if stored is None or (version >= stored[0] and digest != stored[1]):
            state.update((version, digest))
            yield newest

    return rows.groupBy("document_id").applyInPandasWithState(
        decide, rows.schema, "version long, index_hash string", "append", GroupStateTimeout.NoTimeout)


def ingest_documents(events: DataFrame, output: str, checkpoint: str, size: int = vocab.CHUNK_SIZE,
                     overlap: int = vocab.CHUNK_OVERLAP) -> StreamingQuery:
    """Chunk new or changed documents of every micro-batch (:func:`changed_documents`).

    ``events``: document_id, title, version, text, pages. Each batch writes one row per document it indexed,
    also for one that became empty, and the chunks; both folders carry the batch id and are overwritten on
    replay, when Spark hands out the state as it was before the batch.
    """
    pages = events.schema["pages"].dataType

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = durable(batch.withColumn("pages", F.from_json("pages", pages)))
        changed.select("document_id", "version", "index_hash").write.mode("overwrite").parquet(f"{output}/{STATE}/batch={batch_id}")
        document_chunks(changed.drop("index_hash"), size=size, overlap=overlap).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return changed_documents(events, size, overlap).writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into_index(events: DataFrame, path: str, checkpoint: str, size: int = vocab.CHUNK_SIZE,
                      overlap: int = vocab.CHUNK_OVERLAP) -> StreamingQuery:
    """As :func:`ingest_documents`, into a stored index: only the buckets of changed documents are written, one
    snapshot a batch. A replayed batch replaces its own rows. The index must have been written before."""
    pages = events.schema["pages"].dataType

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = durable(batch.withColumn("pages", F.from_json("pages", pages)))
        fresh = durable(document_chunks(changed.drop("index_hash"), size=size, overlap=overlap))
        gone = changed.select("document_id")
        change_index(batch.sparkSession, path, gone, lambda stored: remove_documents(stored, gone).unionByName(fresh.select(*stored.columns)),
                     gone.unionByName(fresh.select("document_id")))

    return changed_documents(events, size, overlap).writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_state(spark: SparkSession, output: str) -> DataFrame:
    """document_id, version, index_hash, batch: what each batch indexed."""
    return spark.read.option("basePath", f"{output}/{STATE}").parquet(f"{output}/{STATE}")


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """Chunks of every document's newest batch; a document whose newest version is empty has none."""
    newest = document_state(spark, output).groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(output).join(newest, ["document_id", "batch"], "left_semi")


def fence_generations(events: DataFrame, documents: Callable[[], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply only events of the current generation; older ones are written as SUPERSEDED.

    ``documents`` returns the stored generations at the time of the batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fenced = generation_fence(batch, documents())
        fenced.write.mode("overwrite").partitionBy("outcome").parquet(f"{output}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_rollup(audit: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and latest change per window and action; late events inside the watermark still count."""
    return audit.withWatermark("created_at", delay).groupBy(F.window("created_at", window), "action").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("created_at").alias("latest"))


def append_stream(rows: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", output).trigger(availableNow=True).start()
