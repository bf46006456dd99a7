"""A stored chunk index: hash buckets that split as they grow, committed as snapshots.

A document's bucket is a suffix of its hash. The directory is a set of suffixes that no other ends in, so a
bucket that outgrows ``BUCKET_ROWS`` gets longer suffixes while the others stay untouched. A change
writes the next content of the buckets it touches aside and then puts one new snapshot file in place by a
rename; readers follow the newest snapshot, so a change that dies before the rename leaves the index as it was.
A snapshot also holds the settings the chunks were made with and, if asked for, the word counts that BM25
needs, kept as deltas.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliarc.operators.retrieve import word_counts

# Rows that one bucket should hold; one with more than twice as many is split.
BUCKET_ROWS = 1_000_000
LONGEST_SUFFIX = 40
SNAPSHOTS = "_snapshots"


def document_hash(document_id: Column) -> Column:
    return F.xxhash64(document_id.cast("string")).bitwiseAND(F.lit((1 << 62) - 1))


# ---- snapshots ---------------------------------------------------------------------------
def _path(spark: SparkSession, name: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    folder, files = _path(spark, f"{path}/{SNAPSHOTS}")
    if not files.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(folder) if not s.getPath().getName().startswith((".", "_")))


def snapshot(spark: SparkSession, path: str, version: str | None = None) -> dict:
    """The newest snapshot, or a named one."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"INDEX_NOT_FOUND: {path}")
    return json.loads(spark.read.text(f"{path}/{SNAPSHOTS}/{version or versions[-1]}", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, state: dict) -> None:
    """Put the next snapshot in place; a change that another one overtook is refused."""
    name = f"{state['version']:012d}"
    written, files = _path(spark, f"{path}/{SNAPSHOTS}/.{uuid.uuid4().hex}")
    place, _ = _path(spark, f"{path}/{SNAPSHOTS}/{name}")
    out = files.create(written, True)
    try:
        out.write(bytearray(json.dumps(state).encode("utf-8")))
    finally:
        out.close()
    if files.exists(place) or not files.rename(written, place):
        files.delete(written, False)
        raise RuntimeError("CONCURRENT_INDEX_CHANGE")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data that none of the last ``keep`` snapshots names, and older snapshots; the number of folders deleted."""
    versions = _versions(spark, path)
    used = {name.split("/")[0] for v in versions[-keep:] for name in _folders(snapshot(spark, path, v))}
    top, files = _path(spark, path)
    gone = [s.getPath() for s in files.listStatus(top) if not s.getPath().getName().startswith("_") and s.getPath().getName() not in used]
    for folder in gone:
        files.delete(folder, True)
    for version in versions[:-keep]:
        files.delete(_path(spark, f"{path}/{SNAPSHOTS}/{version}")[0], False)
    return len(gone)


def _folders(state: dict) -> list[str]:
    return [b["folder"] for b in state["buckets"] if b["folder"]] + state["statistics"]


# ---- buckets -----------------------------------------------------------------------------
def _suffixes(length: int, of: dict | None = None) -> list[dict]:
    """Empty buckets of a hash suffix: the given bucket's, made ``length`` bits longer."""
    bits, depth = (of["bits"], of["depth"]) if of else (0, 0)
    return [{"depth": depth + length, "bits": bits | (more << depth), "rows": 0, "folder": None} for more in range(1 << length)]


def _name(bucket: dict) -> str:
    return f"{bucket['depth']}-{bucket['bits']}"


def _placed(rows: DataFrame, buckets: list[dict]) -> DataFrame:
    """``rows`` with the name of their ``bucket``: the one suffix of the directory that their hash ends in."""
    digest = document_hash(F.col("document_id"))
    out = None
    for depth in sorted({b["depth"] for b in buckets}):  # few: all lengths in use
        names = F.array(*[F.lit(b["bits"]).cast("bigint") for b in buckets if b["depth"] == depth])
        bits = digest.bitwiseAND(F.lit((1 << depth) - 1))
        fits = F.array_contains(names, bits) if depth else F.lit(True)
        name = F.concat(F.lit(f"{depth}-"), bits.cast("string"))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return rows.withColumn("bucket", out)


def _longer(rows: int) -> int:
    """Bits by which a suffix must grow so that a bucket of ``rows`` is cut to size; 0 if it fits."""
    return max(0, (-(-rows // BUCKET_ROWS) - 1).bit_length()) if rows > 2 * BUCKET_ROWS else 0


def _write(rows: DataFrame, path: str, buckets: list[dict]) -> list[dict]:
    """Write placed ``rows`` aside, a file for each bucket; the buckets with their folders and row counts."""
    folder = f"data-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    found = rows.sparkSession.read.schema("bucket string").parquet(f"{path}/{folder}")
    sizes = {r["bucket"]: r["count"] for r in found.groupBy("bucket").count().collect()}
    return [b | {"rows": sizes.get(_name(b), 0), "folder": f"{folder}/bucket={_name(b)}" if _name(b) in sizes else None} for b in buckets]


def _stored(spark: SparkSession, path: str, state: dict, buckets: list[dict]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/{b['folder']}" for b in buckets if b["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


# ---- reading -----------------------------------------------------------------------------
def read_index(spark: SparkSession, path: str, settings: dict | None = None, version: str | None = None) -> DataFrame:
    """The chunks of the newest (or a named) snapshot. With ``settings`` an index made with others is refused."""
    state = snapshot(spark, path, version)
    check_settings(state, settings)
    return _stored(spark, path, state, state["buckets"])


def check_settings(state: dict, settings: dict | None) -> None:
    if settings is not None and state["settings"] != settings:
        raise ValueError("INDEX_SETTINGS_MISMATCH")


def index_counts(spark: SparkSession, path: str) -> DataFrame:
    """The word counts kept with the index (see ``retrieve.word_counts``): its deltas added up."""
    state = snapshot(spark, path)
    if not state["statistics"]:
        raise ValueError("INDEX_WITHOUT_STATISTICS")
    deltas = spark.read.parquet(*[f"{path}/{s}" for s in state["statistics"]])
    return _summed(deltas).filter(F.col("df") > 0)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("scope", "day", "token").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))


def index_buckets(spark: SparkSession, path: str) -> int:
    return len(snapshot(spark, path)["buckets"])


# ---- changing ----------------------------------------------------------------------------
def write_index(chunks: DataFrame, path: str, buckets: int | None = None, settings: dict | None = None, statistics: bool = False) -> None:
    """Write a whole index, as the first snapshot or the next.

    Without a number of buckets the rows are written once under a single suffix, counted, and cut into
    buckets from there, so what makes ``chunks`` runs once. With ``statistics`` word counts are kept too.
    """
    spark, schema = chunks.sparkSession, json.loads(chunks.schema.json())
    versions = _versions(spark, path)
    state = {"version": int(versions[-1]) + 1 if versions else 1, "settings": settings or {}, "schema": schema, "statistics": []}
    directory = _suffixes(max(0, (buckets - 1).bit_length()) if buckets else 0)
    written = _write(_placed(chunks, directory), path, directory)
    longer = _longer(written[0]["rows"]) if not buckets else 0
    if longer:
        rows = _stored(spark, path, state, written)
        directory = _suffixes(longer)
        written = _write(_placed(rows, directory), path, directory)
    state["buckets"] = written
    if statistics:
        state["statistics"] = [_keep_counts(word_counts(_stored(spark, path, state, written)), path)]
    commit(spark, path, state)


def _keep_counts(counts: DataFrame, path: str) -> str:
    folder = f"counts-{uuid.uuid4().hex}"
    counts.write.parquet(f"{path}/{folder}")
    return folder


MOST_DELTAS = 32


def change_index(spark: SparkSession, path: str, documents: DataFrame, change: Callable[[DataFrame], DataFrame],
                 added: DataFrame | None = None) -> None:
    """Commit ``change`` of the stored rows of every bucket that holds one of ``documents`` (document_id).

    ``added`` are the rows that come, known beforehand: a bucket they would overfill is split on the way.
    """
    state = snapshot(spark, path)
    incoming = _placed((documents if added is None else added).select("document_id"), state["buckets"]).groupBy("bucket").count().collect()
    coming = {r["bucket"]: r["count"] for r in incoming}  # a row for each touched bucket
    touched = [b for b in state["buckets"] if _name(b) in coming]
    if not touched:
        return
    rows = {_name(b): b["rows"] + (coming[_name(b)] if added is not None else 0) for b in touched}
    directory = [n for b in touched for n in _suffixes(min(_longer(rows[_name(b)]), LONGEST_SUFFIX - b["depth"]), b)]
    before = _stored(spark, path, state, touched)
    after = change(before).select(*before.columns)
    written = _write(_placed(after, directory), path, directory)
    following = state | {"version": state["version"] + 1, "buckets": [b for b in state["buckets"] if _name(b) not in coming] + written}
    if state["statistics"]:
        gone = word_counts(before).withColumn("df", -F.col("df")).withColumn("size", -F.col("size"))
        delta = _summed(word_counts(_stored(spark, path, state, written)).unionByName(gone)).filter("df <> 0 OR size <> 0")
        if len(state["statistics"]) >= MOST_DELTAS:
            earlier = spark.read.parquet(*[f"{path}/{s}" for s in state["statistics"]])
            following["statistics"] = [_keep_counts(_summed(earlier.unionByName(delta)).filter("df > 0"), path)]
        else:
            following["statistics"] = [*state["statistics"], _keep_counts(delta, path)]
    commit(spark, path, following)
