"""Structure-aware chunking and the chunk index.

Splitting is a column expression: the text is cut at paragraph breaks, rows, list items, sentences and,
for over-long units, words. Which neighbouring pieces make a chunk is decided on their lengths alone,
by prefix sums and the next start of each chunk, so a text of many megabytes takes linear time. No row
of text leaves its task and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.hashing import canonical_json, chunk_id
from foliarc.functions.text import CUT, NON_SPACE, SPACE, let, lines_keeping_breaks, strip, strip_left, strip_right
from foliarc.operators.catalogue import correction_eligible

_ABBREVIATED = vocab.NOT_AFTER_WORD + "(?:" + "|".join(vocab.ABBREVIATIONS) + r")\."
_SENTENCE_CUT = r"((?iu)[.!?]+[\"'»”)]*)(?<!" + _ABBREVIATED + f")(?={SPACE}|\\z)"


def _pieces(text: Column, pattern: str, replacement: str) -> Column:
    """Cut ``text`` where ``replacement`` puts the mark; the pieces join back to the text."""
    return F.filter(F.split(F.regexp_replace(text, pattern, replacement), CUT, -1), lambda piece: piece != "")


def _by_words(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters, at whitespace where possible."""
    rest = max(size - 1, 0)
    piece = (f"(?s){NON_SPACE}(?:.{{0,{rest}}}\\z|.{{0,{rest}}}(?<={NON_SPACE})(?={SPACE})|.{{{rest}}})")
    return let(strip(text), lambda t: _pieces(t, f"({piece})", CUT + "$1"))


def _bounded(piece: Column, size: int) -> Column:
    # _by_words trims, so the outer whitespace is put back to keep the pieces gapless.
    lead = F.substring(piece, F.lit(1), F.length(piece) - F.length(strip_left(piece)))
    tail = F.substring(piece, F.length(strip_right(piece)) + 1, F.length(piece))
    return F.when(F.length(strip(piece)) <= size, F.array(piece)).otherwise(
        F.concat(F.array(lead), _by_words(piece, size), F.array(tail)))


def _is_row(line: Column) -> Column:
    bare = strip(line)
    return (F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit(""))) >= 2) | F.contains(bare, F.lit("\t"))


def _line_blocks(paragraph: Column) -> Column:
    """Rows stand alone; a list item or prose block keeps its continuation lines."""
    def cut(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.when(
            (i > 0) & (_is_row(line) | line.rlike(vocab.BULLET) | _is_row(F.get(lines, i - 1))),
            F.concat(F.lit(CUT), line)).otherwise(line))
        return F.split(F.array_join(marked, ""), CUT, -1)
    return let(lines_keeping_breaks(paragraph), cut)


def _paragraph_pieces(paragraph: Column, size: int) -> Column:
    def of_block(block: Column) -> Column:
        sentences = F.flatten(F.transform(_pieces(block, _SENTENCE_CUT, "$1" + CUT), lambda s: _bounded(s, size)))
        return (F.when(F.length(strip(block)) <= size, F.array(block))
                .when(_is_row(F.get(lines_keeping_breaks(block), F.lit(0))), _bounded(block, size)).otherwise(sentences))
    # Leading whitespace is not part of the paragraph: it must not hide a first-line bullet.
    body = strip_left(paragraph)
    lead = F.substring(paragraph, F.lit(1), F.length(paragraph) - F.length(body))
    long_pieces = F.concat(F.array(lead), F.flatten(F.transform(_line_blocks(body), of_block)))
    return F.when(F.length(strip(paragraph)) <= size, F.array(paragraph)).otherwise(long_pieces)


def text_pieces(text: Column, size: int) -> Column:
    """Pieces that join back to the text; packing keeps each of them whole."""
    paragraphs = _pieces(text, f"({vocab.PARAGRAPH_BREAK})", "$1" + CUT)
    return F.flatten(F.transform(paragraphs, lambda p: _paragraph_pieces(p, size)))


def cut_points(lead: np.ndarray, kept: np.ndarray, length: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """First and last piece of each chunk, one after the other.

    ``lead``: blanks before a piece's text; ``kept``: length of that text, 0 for a blank piece. A chunk
    closes when the next text would exceed ``size``; whole trailing texts within ``overlap`` are repeated.
    """
    units = np.flatnonzero(kept > 0)
    start = (np.cumsum(length) - length + lead)[units]
    end = start + kept[units]
    out, first, after = [], 0, 1
    while len(units):
        after = max(after, int(np.searchsorted(end, start[first] + size, "right")))
        out += [units[first], units[after - 1]]
        if after == len(units):
            break
        repeated = int(np.searchsorted(start, max(end[after - 1] - overlap, end[after] - size), "left"))
        first, after = min(max(first, repeated), after), after + 1
    return np.array(out, np.int32)


def _cuts(lead: Column, kept: Column, length: Column, sizes: Column, overlaps: Column) -> Column:
    """``cut_points`` of every text of an array; only lengths travel."""

    @F.pandas_udf("array<array<int>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if row[0] is None else [
                np.zeros(0, np.int32) if part[0] is None else cut_points(*(np.asarray(p, np.int64) for p in part[:3]), *part[3:])
                for part in zip(*row)] for row in zip(*batch)], dtype=object)

    # Marked so that the optimizer keeps it in a column of its own, never inside a lambda or a derived filter.
    return run.asNondeterministic()(lead, kept, length, sizes, overlaps)


def _with_cuts(rows: DataFrame) -> DataFrame:
    """``rows`` (pieces: array of the pieces of each text; sizes; overlaps) with ``cuts``."""
    def each(measure) -> Column:
        return F.transform("pieces", lambda own: F.transform(own, measure))
    return rows.withColumn("cuts", _cuts(
        each(lambda p: F.length(p) - F.length(strip_left(p))), each(lambda p: F.length(strip(p))), each(F.length),
        F.col("sizes"), F.col("overlaps")))


def _chunk_texts(pieces: Column, cuts: Column) -> Column:
    """The chunks of one text: neighbouring pieces joined, without the blanks around them."""
    places = F.sequence(F.lit(1), F.size(cuts), F.lit(2))
    return F.when(F.size(cuts) > 0, F.transform(places, lambda i: strip(F.array_join(
        F.slice(pieces, F.get(cuts, i - 1) + 1, F.get(cuts, i) - F.get(cuts, i - 1) + 1), "")))).otherwise(F.array().cast("array<string>"))


def split_chunks(rows: DataFrame, text: str, name: str = "chunks", size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """``rows`` with the array ``name`` of chunk texts, each an exact substring of the column ``text``; NULL for a NULL text."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("INVALID_CHUNK_SETTINGS")
    cut = _with_cuts(rows.withColumns({"pieces": F.array(text_pieces(F.col(text), size)), "sizes": F.array(F.lit(size)), "overlaps": F.array(F.lit(overlap))}))
    return cut.select(*rows.columns, F.when(F.col(text).isNotNull(), _chunk_texts(F.get("pieces", F.lit(0)), F.get("cuts", F.lit(0)))).alias(name))


def correction_text(name: Column, value_text: Column, value_number: Column, unit: Column, fact_id: Column) -> Column:
    value = F.concat_ws("; ", value_text, value_number.cast("string"))
    return F.concat(name, F.lit(": "), value, F.lit(" "), F.coalesce(unit, F.lit("")), F.lit(" (correctionId="),
                    fact_id.cast("string"), F.lit(")"))


def _pages() -> Column:
    """The pages of a document; one without pages is a single page without number."""
    return F.when(F.size(F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string>>"))) > 0,
                  F.col("pages")).otherwise(
        F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.col("text").alias("text"))))


def with_index_hash(docs: DataFrame, corrections: DataFrame | None = None, size: int = vocab.CHUNK_SIZE,
                    overlap: int = vocab.CHUNK_OVERLAP, embedding_model: str = "hashed-words",
                    revision: bool = False) -> DataFrame:
    """``docs`` with ``notes`` and ``index_hash``: a digest of all that decides a document's chunks.

    It needs no chunking, so unchanged documents are told apart before the costly part.
    """
    empty = F.array().cast("array<struct<fact_id:string,name:string,value_text:string,value_number:double,"
                           "unit:string,review_status:string>>")
    if corrections is not None:
        notes = corrections.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(
            F.col("fact_id").cast("string").alias("fact_id"), "name", "value_text", "value_number", "unit",
            "review_status"))).alias("notes"))
        docs = docs.join(notes, "document_id", "left").withColumn("notes", F.coalesce("notes", empty))
    else:
        docs = docs.withColumn("notes", empty)
    described = F.struct(
        F.lit(overlap).alias("chunk_overlap"), F.lit(size).alias("chunk_size"), F.col("notes").alias("corrections"),
        F.lit(embedding_model).alias("embedding_model"), F.col("pages").alias("pages"),
        (F.col("revision_id") if revision else F.lit(None).cast("string")).alias("revision_id"),
        F.lit(vocab.SPLITTER_VERSION).alias("splitter"), F.col("text").alias("text"), F.col("title").alias("title"),
        F.col("version").alias("version"))
    return docs.withColumn("index_hash", F.sha2(canonical_json(described), 256))


def document_chunks(docs: DataFrame, corrections: DataFrame | None = None, size: int = vocab.CHUNK_SIZE,
                    overlap: int = vocab.CHUNK_OVERLAP, embedding_model: str = "hashed-words",
                    revision: bool = False) -> DataFrame:
    """Chunks of every document: pages in order, then reviewed corrections.

    ``docs``: document_id, title, version, text, pages (array of page_number, text; may be empty
    or NULL) and, with ``revision``, revision_id.
    """
    if size <= len(vocab.CORRECTION_MARKER) or not 0 <= overlap < size:
        raise ValueError("INVALID_CHUNK_SETTINGS")
    ids = ["document_id", "revision_id"] if revision else ["document_id"]
    hashed = with_index_hash(docs, corrections, size, overlap, embedding_model, revision)
    pages = _pages()
    body = hashed.select(*ids, "title", "version", "index_hash", pages.alias("pages"), "notes")
    marker = vocab.CORRECTION_MARKER
    notes_used = F.filter("notes", lambda n: correction_eligible(n["review_status"]))
    said = F.transform(notes_used, lambda n: correction_text(n["name"], n["value_text"], n["value_number"], n["unit"], n["fact_id"]))
    parts = body.select(*ids, "title", "version", "index_hash", "pages", F.size("pages").alias("n_pages"), said.alias("said"))
    parts = parts.select("*", F.concat(F.transform("pages", lambda p: text_pieces(p["text"], size)),
                                       F.transform("said", lambda t: text_pieces(t, size - len(marker)))).alias("pieces"),
                         *[F.concat(F.array_repeat(F.lit(a), F.size("pages")), F.array_repeat(F.lit(b), F.size("said"))).alias(name)
                           for name, a, b in (("sizes", size, size - len(marker)), ("overlaps", overlap, 0))])

    def of_part(own: Column, i: Column) -> Column:
        corrected = i >= F.col("n_pages")
        return F.transform(_chunk_texts(own, F.get("cuts", i)), lambda c: F.struct(
            F.when(corrected, F.concat(F.lit(marker), c)).otherwise(c).alias("text"),
            F.when(corrected, F.lit(0)).otherwise(F.coalesce(F.get("pages", i)["page_number"], F.lit(0))).alias("page_number"),
            corrected.alias("user_correction")))

    rows = _with_cuts(parts).select(
        *ids, "title", "version", "index_hash",
        F.posexplode_outer(F.flatten(F.transform("pieces", of_part))).alias("at", "chunk")).filter("chunk IS NOT NULL")
    position = (F.col("at") + 1).alias("position")
    return rows.select(
        chunk_id(F.col("document_id"), F.col("index_hash"), F.col("at") + 1).alias("chunk_id"), *ids,
        F.col("title").alias("source"), "version", position, "chunk.page_number", "chunk.user_correction",
        "chunk.text", "index_hash")


def plan_index(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose index hash is new: the costly chunking is skipped for the others.

    ``docs`` comes from :func:`with_index_hash`; both sides carry document_id and index_hash.
    """
    return docs.join(stored.select("document_id", "index_hash"), ["document_id", "index_hash"], "left_anti")


def index_status(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, chunks, last_indexed_at."""
    rows = files.select(F.lit("f").alias("kind"), "indexed_at").unionByName(
        chunks.select(F.lit("c").alias("kind"), F.lit(None).cast("timestamp").alias("indexed_at")))
    return rows.agg(F.count_if(F.col("kind") == "f").alias("files"), F.count_if(F.col("kind") == "c").alias("chunks"),
                    F.max("indexed_at").alias("last_indexed_at"))


def public_status(status: DataFrame) -> DataFrame:
    return status.select(F.when(F.col("files") > 0, F.lit("READY")).otherwise(F.lit("EMPTY")).alias("status"),
                         "files", "chunks")


def source_of(chunks: DataFrame, demo: bool = False) -> DataFrame:
    """Citation fields of a chunk; page 0 means none; a demo source hides the document id."""
    fields = ["source", "chunk_id", "position", F.nullif(F.col("page_number"), F.lit(0)).alias("page_number"), "text",
              "version", F.coalesce("user_correction", F.lit(False)).alias("user_correction")]
    return chunks.select(*fields, *([] if demo else ["document_id"]))


def batch_numbers(first: np.ndarray, size: np.ndarray, max_items: int, max_size: int, state: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Batch of each row and the state (batch, items, size) after the last; ``first`` marks where a key begins.

    Each batch's end is looked up in the prefix sums of the sizes, so the work is linear in the rows.
    """
    out, upto = np.zeros(len(size), np.int32), np.concatenate([[0], np.cumsum(size)])
    edges = np.unique(np.concatenate([[0], np.flatnonzero(first), [len(size)]]))
    for low, high in zip(edges[:-1], edges[1:]):
        if first[low]:
            state = (0, 0, 0)
        at = low
        while at < high:
            batch, items, held = state
            end = int(np.searchsorted(upto, upto[at] + max_size - held, "right")) - 1 if held <= max_size else at
            end = min(max(end, at), at + max_items - items, high)
            if end == at and items:
                state = (batch + 1, 0, 0)
                continue
            end = max(end, at + 1)
            out[at:end] = batch
            state = (batch, items + end - at, held + int(upto[end] - upto[at]))
            at = end
    return out, state


def pack_batches(items: DataFrame, keys: list[str], order: list[str], size: Column, max_items: int,
                 max_size: int) -> DataFrame:
    """Number the batches of each key: a new batch starts when a count or size limit would be hit.

    A key's rows come in order, sorted by Spark, and only the open batch's count and size are carried
    from row to row: a key of any length takes linear time and no memory. A NULL size counts as 0.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    rows = items.select("*", (place == 1).alias("__first"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("__size"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, 0, 0)
        for batch in batches:
            first, sizes = (batch[c].to_numpy(zero_copy_only=False) for c in ("__first", "__size"))
            numbers, state = batch_numbers(first.astype(bool), sizes, max_items, max_size, state)
            kept = [c for c in batch.schema.names if c not in ("__first", "__size", "batch")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(numbers)], names=[*kept, "batch"])

    return rows.mapInArrow(run, kinds + ", batch int")
