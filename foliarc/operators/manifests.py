"""Content fingerprints and the comparison of a restored archive with its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON; NULLs are kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# Leading hex digits of the groups of each level; a group of the first holds a table's share of 16**7.
LEVELS = (7, 5, 3)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """rows, sha256 of a table's content, independent of row order and partitioning.

    Equal rows are counted first. Row hashes are then sorted and hashed within groups of their
    leading digits, those hashes within wider groups, and at last at most 4096 of them together:
    the first level has as many groups as the table needs, so no task gathers a share that grows with it.
    """
    hashed = df.select(row_hash(df.columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    level = hashed.select(F.col("h").alias("key"), F.concat_ws(":", "h", "n").alias("item"), "n")
    for digits in LEVELS:
        group = F.substring("key", 1, digits)
        level = level.groupBy(group.alias("key")).agg(_joined("item").alias("h"), F.sum("n").alias("n")).select(
            "key", F.concat_ws(":", "key", "h").alias("item"), "n")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), _joined("item").alias("sha256"))


def _joined(item: str) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256)


def file_set_fingerprint(files: DataFrame) -> DataFrame:
    """sha256 of a path -> sha256 map."""
    return table_fingerprint(files.select("path", "sha256"))


def compare_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, changed); both sides carry path, sha256."""
    joined = expected.select("path", F.col("sha256").alias("want")).join(
        actual.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = (F.when(F.col("have").isNull(), F.lit("missing")).when(F.col("want").isNull(), F.lit("unexpected"))
               .when(F.col("want") != F.col("have"), F.lit("changed")))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def compare_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """table, problem (missing, unexpected, row-count, content); both sides carry table, rows, sha256."""
    joined = expected.select("table", F.col("rows").alias("want_rows"), F.col("sha256").alias("want")).join(
        actual.select("table", F.col("rows").alias("have_rows"), F.col("sha256").alias("have")), "table", "full_outer")
    problem = (F.when(F.col("have").isNull(), F.lit("missing")).when(F.col("want").isNull(), F.lit("unexpected"))
               .when(F.col("want_rows") != F.col("have_rows"), F.lit("row-count"))
               .when(F.col("want") != F.col("have"), F.lit("content")))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("table", "problem")


def reference_issues(references: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem of referenced originals that are missing or differ; both sides carry path, sha256."""
    joined = references.select("path", F.col("sha256").alias("want")).join(
        files.select("path", F.col("sha256").alias("have")), "path", "left")
    problem = (F.when(F.col("have").isNull(), F.lit("missing"))
               .when(F.col("want").isNotNull() & (F.col("want") != F.col("have")), F.lit("sha256-mismatch")))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def new_reference_issues(references: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """Reference issues that the backup did not already record (path, problem)."""
    return reference_issues(references, files).join(known.select("path", "problem"), ["path", "problem"], "left_anti")


def verify_restore(tables: tuple[DataFrame, DataFrame], files: tuple[DataFrame, DataFrame], references: DataFrame,
                   known: DataFrame) -> DataFrame:
    """part, name, problem for every difference; no row means a complete restore."""
    rows = compare_tables(*tables).select(F.lit("table").alias("part"), F.col("table").alias("name"), "problem")
    rows = rows.unionByName(compare_files(*files).select(F.lit("file").alias("part"), F.col("path").alias("name"), "problem"))
    broken = new_reference_issues(references, files[1], known)
    return rows.unionByName(broken.select(F.lit("reference").alias("part"), F.col("path").alias("name"), "problem"))


def backup_summary(tables: DataFrame, files: DataFrame) -> DataFrame:
    """tables, rows, files, documents of a backup manifest."""
    both = tables.select("rows", F.lit(1).alias("t"), F.lit(0).alias("f"), F.when(
        F.col("table") == "documents", F.col("rows")).alias("d")).unionByName(
        files.select(F.lit(0).cast("bigint").alias("rows"), F.lit(0).alias("t"), F.lit(1).alias("f"),
                     F.lit(None).cast("bigint").alias("d")))
    return both.agg(F.sum("t").alias("tables"), F.sum("rows").alias("rows"), F.sum("f").alias("files"),
                    F.coalesce(F.sum("d"), F.lit(0)).alias("documents"))
