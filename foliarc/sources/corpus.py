"""Corpus scans: text files, page tables, table cells, folder reconciliation and manifest audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.text import non_blank, words
from foliarc.operators.lab import is_header


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Files under ``folder``: path, modified_at, bytes, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        if glob.startswith("/") or ".." in glob or "\\" in glob or ":" in glob:
            raise ValueError("PATH_NOT_ALLOWED")
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified_at"),
                                      F.col("length").alias("bytes"), "content")


def split_supported(listing: DataFrame, extensions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by file extension; skipped rows carry a reason."""
    ok = suffix(F.col("path")).isin(extensions or vocab.SUPPORTED_EXTENSIONS)
    skipped = listing.filter(~ok).select(F.col("path").alias("source"), F.lit("UNSUPPORTED_FORMAT").alias("reason"))
    return listing.filter(ok), skipped


def decode_texts(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, errors): strict UTF-8 without its byte-order mark; oversized or undecodable files are errors."""
    has_mark = F.substring(F.hex(F.substring("content", 1, 3)), 1, 6) == "EFBBBF"
    body = F.when(has_mark, F.call_function("substring", F.col("content"), F.lit(4))).otherwise(F.col("content"))
    too_large = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    code = (F.when(too_large, F.lit("FILE_TOO_LARGE"))
            .when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit("INVALID_ENCODING")))
    coded = files.withColumn("code", code)
    texts = coded.filter(F.col("code").isNull()).select(
        "path", "bytes", F.sha2("content", 256).alias("sha256"), F.decode(body, "UTF-8").alias("text"))
    return texts, coded.filter(F.col("code").isNotNull()).select(F.col("path").alias("source"), "code")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One row per document from (document_id, page_number, text): joined text, pages, blank pages, status."""
    gathered = pages.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    blank = F.transform(F.filter("pages", lambda p: ~non_blank(p["text"])), lambda p: p["page_number"].cast("string"))
    all_blank = F.size(blank) == F.size("pages")
    return gathered.select(
        "document_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), "pages",
        F.array_join(blank, ", ").alias("blank_pages"),
        F.when(all_blank, F.lit("UNSUPPORTED_OCR_REQUIRED")).otherwise(F.lit("PARSED")).alias("status"))


def reflow_tables(cells: DataFrame) -> DataFrame:
    """document_id, page, text: recognised tables of (document_id, page, table, row, cells) as tab lines.

    The first row decides; a table with an unknown header is left out. Each table ends with a blank line.
    """
    clean = cells.withColumn("cells", F.transform("cells", lambda c: F.array_join(
        words(F.coalesce(c, F.lit(""))), " ")))
    heads = clean.filter("row = 0").filter(is_header(F.col("cells"), vocab.TABLE_HEADERS)).select(
        "document_id", "page", "table")
    body = clean.filter("row > 0").join(heads, ["document_id", "page", "table"], "left_semi").select(
        "document_id", "page", "table", "row", F.array_join("cells", "\t").alias("line"))
    top = heads.select("document_id", "page", "table", F.lit(0).alias("row"),
                       F.lit(vocab.TABLE_HEADER_LINE).alias("line"))
    end = heads.select("document_id", "page", "table", F.lit(2147483647).alias("row"), F.lit("").alias("line"))
    rows = body.withColumn("row", F.col("row").cast("int")).unionByName(top).unionByName(end)
    page = rows.groupBy("document_id", "page").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("table", "row", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    return page.select("document_id", "page", F.when(
        F.col("page") == 1, F.concat(F.lit(vocab.TABLE_TITLE_LINE + "\n"), F.col("lines"))).otherwise(F.col("lines"))
        .alias("text"))


def sync_folder(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """source, outcome: indexed, unchanged or removed, over the whole persisted catalogue.

    ``listing``: source, sha256 of the readable files, plus ``selected`` for the files of a narrow
    glob; ``catalogue``: source, sha256. A file outside the glob keeps its entry; a vanished one goes.
    """
    if "selected" not in listing.columns:
        listing = listing.withColumn("selected", F.lit(True))
    new = listing.select("source", F.col("sha256").alias("new_hash"), "selected")
    old = catalogue.select("source", F.col("sha256").alias("old_hash"))
    outcome = (F.when(F.col("new_hash").isNull(), F.lit("removed"))
               .when(F.col("new_hash").eqNullSafe(F.col("old_hash")) | ~F.col("selected"), F.lit("unchanged"))
               .otherwise(F.lit("indexed")))
    joined = new.join(old, "source", "full_outer")
    return joined.filter(F.col("old_hash").isNotNull() | F.coalesce("selected", F.lit(False))).select(
        "source", outcome.alias("outcome"))


def check_gold(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, problem for originals that are missing or differ from the manifest's sha256."""
    stored = files.select("name", F.sha2("content", 256).alias("actual"))
    joined = manifest.select("name", "sha256").join(stored, "name", "left")
    problem = (F.when(F.col("actual").isNull(), F.lit("missing"))
               .when(F.col("actual") != F.col("sha256"), F.lit("sha256-mismatch")))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("name", "problem")


def audit_corpus(manifest: DataFrame, files: DataFrame, min_plain_bytes: int = 512000) -> DataFrame:
    """problem, path, one row per broken rule of a corpus manifest.

    Both sides carry path, bytes, sha256. Rules: exact path cover, equal bytes and digest, known
    extension, no repeated digest, enough plain text.
    """
    want = manifest.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_hash"))
    have = files.select("path", "bytes", "sha256")
    joined = want.join(have, "path", "full_outer")
    problem = (F.when(F.col("sha256").isNull(), F.lit("missing")).when(F.col("want_hash").isNull(), F.lit("unexpected"))
               .when((F.col("bytes") != F.col("want_bytes")) | (F.col("sha256") != F.col("want_hash")), F.lit("changed"))
               .when(~suffix(F.col("path")).isin(vocab.SUPPORTED_EXTENSIONS), F.lit("unsupported")))
    rows = joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("problem", "path")
    repeated = have.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n > 1")
    plain = have.agg(F.coalesce(F.sum(F.when(suffix(F.col("path")) != "pdf", F.col("bytes"))), F.lit(0)).alias("b"))
    return rows.unionByName(repeated.select(F.lit("duplicate").alias("problem"), "path")).unionByName(
        plain.filter(F.col("b") < min_plain_bytes).select(F.lit("too-small").alias("problem"),
                                                          F.lit(None).cast("string").alias("path")))
