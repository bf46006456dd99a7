"""Lossless source blocks: paragraphs and separators with byte spans, whitespace mapping and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.hashing import canonical_hash
from foliarc.functions.text import CUT, SPACE, bytes_text, let, non_blank, span_text

_BREAK = r"(\n[ \t]*\n)"
# A maximal whitespace run other than one plain space.
_MAPPED_RUN = f"({SPACE}{{2,}}|(?! ){SPACE})"
_SPAN = "struct<endByte:int,pageIndex:int,startByte:int>"
_MAPPING = f"array<struct<normalizedEndByte:int,normalizedStartByte:int,operation:string,source:{_SPAN}>>"
_BLOCK = f"struct<blockId:string,kind:string,mapping:{_MAPPING},normalizedText:string,source:{_SPAN}>"


def _span(page: Column, start: Column, end: Column) -> Column:
    return F.struct(end.cast("int").alias("endByte"), page.cast("int").alias("pageIndex"),
                    start.cast("int").alias("startByte"))


def _mapping(raw: Column, page: Column, base: Column) -> Column:
    segments = F.filter(F.split(F.regexp_replace(raw, _MAPPED_RUN, CUT + "$1" + CUT), CUT, -1), lambda s: s != "")

    def entries(parts: Column) -> Column:
        def blank(segment: Column) -> Column:
            return ~non_blank(segment) & (segment != " ")

        def entry(segment: Column, at: Column, n: Column) -> Column:
            size = F.octet_length(segment)
            width = F.when(blank(segment), F.lit(1)).otherwise(size)
            return F.struct(
                (n + width).alias("normalizedEndByte"), n.alias("normalizedStartByte"),
                F.when(blank(segment), F.lit("WHITESPACE")).otherwise(F.lit("IDENTITY")).alias("operation"),
                _span(page, at, at + size).alias("source"))

        widths = F.transform(parts, lambda s: F.when(blank(s), F.lit(1)).otherwise(F.octet_length(s)))
        return let(_starts(F.transform(parts, F.octet_length), base.cast("int")), lambda at: let(
            _starts(widths, F.lit(0)), lambda n: F.transform(parts, lambda s, i: entry(s, F.get(at, i), F.get(n, i)))))

    return let(segments, entries).cast(_MAPPING)


def _starts(sizes: Column, first: Column) -> Column:
    """Where each part starts; only these numbers are carried along, not what is built from them."""
    return F.aggregate(sizes, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda state, size: F.struct(
        (state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"])


def page_blocks(text: Column, page_index: Column) -> Column:
    """Blocks of one page; concatenated they are the page, byte for byte."""
    pieces = F.split(F.regexp_replace(text, _BREAK, CUT + "$1" + CUT), CUT, -1)

    def block(raw: Column, number: Column, at: Column) -> Column:
        return F.struct(
            F.concat(F.lit("p"), page_index.cast("string"), F.lit(":b"), number.cast("string")).alias("blockId"),
            F.when(non_blank(raw), F.lit("paragraph")).otherwise(F.lit("separator")).alias("kind"),
            _mapping(raw, page_index, at).alias("mapping"),
            F.regexp_replace(raw, f"{SPACE}+", " ").alias("normalizedText"),
            _span(page_index, at, at + F.octet_length(raw)).alias("source"))

    def built(parts: Column) -> Column:
        return let(_starts(F.transform(parts, F.octet_length), F.lit(0)), lambda at: F.filter(F.transform(
            parts, lambda raw, i: F.when(raw != "", block(raw, i, F.get(at, i)))), lambda b: b.isNotNull()))

    return let(pieces, built).cast(f"array<{_BLOCK}>")


def canonical_pages(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.struct(p["page_number"].alias("pageNumber"), p["text"].alias("text")))


def build_blocks(docs: DataFrame) -> DataFrame:
    """document_id, parser_version, pages, blocks, source_hash, ir_hash from document_id, parser_version, pages."""
    blocks = F.flatten(F.transform("pages", lambda page, i: page_blocks(page["text"], i)))
    built = docs.select("document_id", "parser_version", "pages", blocks.alias("blocks"))
    built = built.withColumn("source_hash", F.sha2(_pages_json(F.col("pages")), 256))
    return built.withColumn("ir_hash", _ir_hash())


def _pages_json(pages: Column) -> Column:
    # canonical_json takes a struct; the array of pages is cut out of a one-field object.
    from foliarc.functions.hashing import canonical_json

    text = canonical_json(F.struct(canonical_pages(pages).alias("p")))
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _ir_hash() -> Column:
    return canonical_hash(F.struct(
        F.col("blocks").alias("blocks"), F.col("document_id").cast("string").alias("documentId"),
        F.lit(vocab.NORMALIZER_VERSION).alias("normalizerVersion"), canonical_pages(F.col("pages")).alias("pages"),
        F.col("parser_version").alias("parserVersion"), F.lit(vocab.IR_VERSION).alias("schemaVersion"),
        F.col("source_hash").alias("sourceHash"), F.lit("SOURCE_ONLY").alias("stage")))


def block_rows(ir: DataFrame) -> DataFrame:
    """One row per block with its exact source text."""
    rows = ir.select("document_id", "pages", F.posexplode_outer("blocks").alias("block_order", "b")).filter("b IS NOT NULL")
    page = F.get(F.col("pages"), F.col("b.source.pageIndex"))["text"]
    return rows.select(
        "document_id", "block_order", F.col("b.blockId").alias("block_id"), F.col("b.kind").alias("kind"),
        F.col("b.source.pageIndex").alias("page_index"), F.col("b.source.startByte").alias("start_byte"),
        F.col("b.source.endByte").alias("end_byte"), F.col("b.normalizedText").alias("normalized_text"),
        span_text(page, F.col("b.source.startByte"), F.col("b.source.endByte")).alias("text"),
        F.col("b.mapping").alias("mapping"))


def verify_blocks(ir: DataFrame) -> DataFrame:
    """document_id and violation codes of stored blocks; an empty list is a valid document."""
    rebuilt = ir.select("*", F.flatten(F.transform("pages", lambda p, i: page_blocks(p["text"], i))).alias("_again"),
                        F.sha2(_pages_json(F.col("pages")), 256).alias("_source"), _ir_hash().alias("_hash"),
                        F.transform("pages", lambda p: F.encode(p["text"], "UTF-8")).alias("_raw"))
    sizes = F.transform("pages", lambda p: F.octet_length(p["text"]))

    def contiguous(blocks: Column) -> Column:
        """Every block starts where the previous one of its page ended, and pages ascend."""
        state = F.aggregate(
            blocks, F.struct(F.lit(0).alias("page"), F.lit(0).alias("end"), F.lit(True).alias("ok")),
            lambda s, b: F.struct(
                b["source"]["pageIndex"].alias("page"), b["source"]["endByte"].alias("end"),
                (s["ok"] & (b["source"]["pageIndex"] >= s["page"])
                 & (b["source"]["startByte"] == F.when(b["source"]["pageIndex"] == s["page"], s["end"])
                    .otherwise(F.lit(0))) & (b["source"]["endByte"] > b["source"]["startByte"])).alias("ok")))
        return state["ok"]

    covered = F.forall(F.transform(sizes, lambda size, i: F.coalesce(F.array_max(F.transform(
        F.filter("blocks", lambda b: b["source"]["pageIndex"] == i), lambda b: b["source"]["endByte"])),
        F.lit(0)) == size), lambda ok: ok)
    unique = F.size(F.array_distinct(F.transform("blocks", lambda b: b["blockId"]))) == F.size("blocks")
    kinds = F.forall("blocks", lambda b: b["kind"].isin("paragraph", "separator") & (F.size(b["mapping"]) > 0))

    def mapped(block: Column) -> Column:
        def text_of(m: Column) -> Column:
            return bytes_text(F.get(F.col("_raw"), block["source"]["pageIndex"]), m["source"]["startByte"], m["source"]["endByte"])

        rendered = F.array_join(F.transform(block["mapping"], lambda m: F.when(
            m["operation"] == "WHITESPACE", F.lit(" ")).otherwise(text_of(m))), "")
        blank = F.forall(F.filter(block["mapping"], lambda m: m["operation"] == "WHITESPACE"), lambda m: ~non_blank(text_of(m)))
        gapless = F.aggregate(
            block["mapping"], F.struct(block["source"]["startByte"].alias("at"), F.lit(0).alias("n"),
                                       F.lit(True).alias("ok")),
            lambda s, m: F.struct(
                m["source"]["endByte"].alias("at"), m["normalizedEndByte"].alias("n"),
                (s["ok"] & (m["source"]["startByte"] == s["at"]) & (m["normalizedStartByte"] == s["n"])
                 & (m["source"]["pageIndex"] == block["source"]["pageIndex"])).alias("ok")),
            lambda s: s["ok"] & (s["at"] == block["source"]["endByte"]))
        return (rendered == block["normalizedText"]) & blank & gapless

    rules = [("PAGES_HASH", F.col("source_hash") == F.col("_source")), ("IR_HASH", F.col("ir_hash") == F.col("_hash")),
             ("REBUILD", F.col("blocks") == F.col("_again")), ("CONTIGUOUS", contiguous(F.col("blocks"))),
             ("COVERED", covered), ("UNIQUE_IDS", unique), ("KINDS", kinds), ("MAPPING", F.forall("blocks", mapped))]
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    return rebuilt.select("document_id", let(codes, lambda c: c).alias("violations"))
