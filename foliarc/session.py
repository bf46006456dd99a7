"""Session defaults, checkpoint folder and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted size stays below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
WAVES = 4  # tasks a core of row-heavy work, so that a slow one holds up little
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "foliarc", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A cluster session without it is refused, since executors could not read each other's files;
    only a local session gets a temporary one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|-|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    A checkpoint would compute the last stage twice, to count it and to write it. The shuffle files of
    the write are removed when it ends; what reads the table needs none of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliarc-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has so few rows that a copy on every executor is safe."""
    rows = limit // max(1, bytes_per_row)
    return df.limit(rows + 1).agg(F.count(F.lit(1))).first()[0] <= rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of row-heavy work evenly over ``WAVES`` tasks a core, or over as many as the scan has splits.

    Splits say nothing about rows: a file of one row group has all of them in one split, however many splits
    its bytes make. Dealing costs an exchange of the rows, which is little beside such work.
    """
    tasks = max(WAVES * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(tasks, *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` with the session's full partition count.

    A stated count is not coalesced by size, which suits work that is heavier than its bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
