"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc.session import durable

# Code points at which Python ends a word but the tokenizer libraries do not.
SEPARATOR_CONTROLS = "\x1c\x1d\x1e\x1f"


staged = durable


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``staged`` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def release_memory() -> None:
    """Hand memory that a worker no longer uses back to the system; workers outlive their tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Remembered:
    """A bounded dictionary in two generations: units used since the last change of generation survive it."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.young: dict = {}
        self.old: dict = {}

    def get(self, unit):
        value = self.young.get(unit)
        if value is None:
            value = self.old.get(unit)
            if value is not None:
                self.put(unit, value)
        return value

    def put(self, unit, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[unit] = value


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
