"""Text expressions: case folding, tokens, whitespace, lines, spans and quotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliarc import vocab

# Unicode whitespace written out: Java's \s is ASCII only. Latin characters stand alone, which Java looks up in one
# table; the others are behind one range, so an ordinary letter takes two tests instead of one per member.
_SPACES = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
SPACE = f"[{_SPACES}]"
NON_SPACE = f"[^{_SPACES}]"
SPACE_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
# A Unicode noncharacter marks cut positions while a text is being split.
CUT = "\ufdd0"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def regex_extract(text: Column, pattern: Column, group: int = 0) -> Column:
    """``regexp_extract`` with a pattern that differs per row; no match gives NULL."""
    found = F.call_function("regexp_extract", text, pattern, F.lit(group))
    return F.when(F.call_function("rlike", text, pattern), found)


def quoted(text: Column) -> Column:
    """Regex that matches ``text`` literally."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def fold_case(text: Column) -> Column:
    """Full case folding for comparisons (sharp s and final sigma included)."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """Whitespace runs become one space and the ends are trimmed."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def norm(text: Column) -> Column:
    """Case-folded :func:`collapse`; NULL becomes the empty text."""
    return fold_case(collapse(F.coalesce(text.cast("string"), F.lit(""))))


def plain(text: Column) -> Column:
    """Visible words: markdown markers, table pipes and list dashes dropped."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[|*_#`]", " ")
    return norm(F.regexp_replace(bare, f"(?m)^{SPACE}*[-•]{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Case-folded word runs; a text without words gives one placeholder token."""
    words = F.regexp_extract_all(fold_case(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.when(text.rlike(vocab.WORD), words).when(text.isNotNull(), F.array(F.lit("_")))


def non_blank(text: Column) -> Column:
    return strip(text) != ""


def lines_keeping_breaks(text: Column) -> Column:
    """Physical lines, each with its line break; joined they give the text back."""
    marked = F.regexp_replace(text, f"({LINE_BREAK})", "$1" + CUT)
    return F.filter(F.split(marked, CUT, -1), lambda line: line != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda word: word != "")


def swap_first_case(text: Column) -> Column:
    head, tail = F.substring(text, 1, 1), F.substring(text, 2, 2147483647)
    return F.concat(F.when(F.upper(head) == head, F.lower(head)).otherwise(F.upper(head)), tail)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def span_text(page: Column, start_byte: Column, end_byte: Column) -> Column:
    """Text of a half-open UTF-8 byte range; NULL when out of bounds or splitting a character."""
    return bytes_text(F.encode(page, "UTF-8"), start_byte, end_byte)


def bytes_text(raw: Column, start_byte: Column, end_byte: Column) -> Column:
    """:func:`span_text` of a page that is encoded already: many spans of one page then cost their own bytes."""
    piece = F.call_function("substring", raw, (start_byte + 1).cast("int"), (end_byte - start_byte).cast("int"))
    inside = (start_byte >= 0) & (end_byte >= start_byte) & (end_byte <= F.octet_length(raw))
    return F.when(inside & F.is_valid_utf8(piece.cast("string")), F.decode(piece, "UTF-8"))


def occurrences(text: Column, quote: Column) -> Column:
    """Byte ranges of every occurrence of ``quote`` in ``text``, overlapping ones included."""
    # A zero-width look-ahead cuts the text in front of each occurrence.
    cuts = F.call_function(
        "split", text, F.concat(F.lit("(?="), quoted(quote), F.lit(")")), F.lit(-1))
    starts = F.aggregate(
        cuts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda state, piece: F.struct(
            (state["at"] + F.octet_length(piece)).alias("at"),
            F.concat(state["starts"], F.array(state["at"])).alias("starts")),
        lambda state: state["starts"])
    size = F.octet_length(quote)
    # The first piece starts at 0 whether or not the text begins with the quote.
    hits = F.filter(starts, lambda at: (at > 0) | F.startswith(text, quote))
    ranges = F.transform(hits, lambda at: F.struct(at.alias("start_byte"), (at + size).alias("end_byte")))
    return F.when((F.length(quote) > 0) & F.contains(text, quote), ranges).otherwise(
        F.array().cast("array<struct<start_byte:int,end_byte:int>>"))


def count_occurrences(text: Column, quote: Column) -> Column:
    """Number of non-overlapping occurrences; 0 for an empty quote."""
    removed = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    return F.when(F.length(quote) > 0, (removed / F.length(quote)).cast("int")).otherwise(F.lit(0))


def contains_command(text: Column) -> Column:
    """Embedded instruction to a tool or to the extraction itself."""
    return text.rlike(vocab.COMMAND)


def _whole_line_span(proposed: Column, source: Column, max_chars: int | None) -> Column:
    """Source span from the first to the last proposed line, all lines found whole and in order."""
    wanted = F.filter(F.transform(lines_keeping_breaks(proposed), strip), lambda line: line != "")

    def step(want: Column):
        def visit(state: Column, raw: Column) -> Column:
            hit = (state["k"] < F.size(want)) & (strip(raw) == F.get(want, state["k"]))
            lead = F.length(raw) - F.length(strip_left(raw))
            return F.struct(
                (state["k"] + hit.cast("int")).alias("k"),
                F.when(hit & (state["k"] == 0), state["at"] + lead).otherwise(state["first"]).alias("first"),
                F.when(hit, state["at"] + F.length(strip_right(raw))).otherwise(state["last"]).alias("last"),
                (state["at"] + F.length(raw)).alias("at"))
        return visit

    def walk(want: Column) -> Column:
        zero = F.lit(0)
        return let(
            F.aggregate(lines_keeping_breaks(source),
                        F.struct(zero.alias("k"), zero.alias("first"), zero.alias("last"), zero.alias("at")),
                        step(want)),
            lambda end: F.when(
                (end["k"] == F.size(want))
                & (F.lit(True) if max_chars is None else end["last"] - end["first"] <= max_chars),
                F.substring(source, end["first"] + 1, end["last"] - end["first"])))

    # Only two lines or more make a span: for one line the source is not walked.
    return let(wanted, lambda want: F.when(F.size(want) >= 2, walk(want)))


def verified_excerpt(proposed: Column, source: Column, max_chars: int | None = None) -> Column:
    """Contiguous source text behind a proposed quote, or NULL; ``max_chars`` bounds a span of whole lines.

    Exact containment first, then the same words with other whitespace, then whole source
    lines in order. Fragments are never joined. Blanks inside a number are dropped at first; a
    source that holds them itself (``4.0.`` and a digit on the next line) is met by the quote as it stands.
    """
    given = strip(proposed)
    joined = F.regexp_replace(given, r"(?<=\d)([.,])" + SPACE + r"+(?=\d)", "$1")

    def decide(quote: Column) -> Column:
        spaced = F.array_join(F.transform(words(quote), quoted), SPACE + "+")
        return (
            F.when(F.length(quote) == 0, F.lit(None).cast("string"))
            .when(F.contains(source, quote), quote)
            .when(F.contains(collapse(source), collapse(quote)), regex_extract(source, spaced))
            .otherwise(_whole_line_span(quote, source, max_chars)))

    return F.aggregate(F.array_distinct(F.array(joined, given)), F.lit(None).cast("string"),
                       lambda found, quote: F.coalesce(found, decide(quote)))


def complete_excerpt(proposed: Column, source: Column, max_chars: int | None = None) -> Column:
    """Verified quote widened to whole source lines; the first letter's case may be restored."""
    exact = F.coalesce(verified_excerpt(proposed, source, max_chars),
                       verified_excerpt(swap_first_case(strip(proposed)), source, max_chars))

    def widen(quote: Column) -> Column:
        at = F.call_function("locate", quote, source)
        head = F.substring_index(F.substring(source, F.lit(1), at - 1), "\n", -1)
        tail = F.substring_index(F.substring(source, at + F.length(quote), F.length(source)), "\n", 1)
        return let(F.concat(head, quote, tail),
                   lambda full: full if max_chars is None else F.when(F.length(full) <= max_chars, full))

    return let(exact, widen)


def span_pattern(span: Column) -> Column:
    """Literal pattern bounded only where the span itself begins or ends in a word character."""
    return F.concat(
        F.when(span.rlike("^" + vocab.WORD), F.lit(vocab.NOT_AFTER_WORD)).otherwise(F.lit("")),
        quoted(span),
        F.when(span.rlike(vocab.WORD + r"\z"), F.lit(vocab.NOT_BEFORE_WORD)).otherwise(F.lit("")))


def letters(index: Column) -> Column:
    """0, 1, .. 25, 26, .. as A, B, .. Z, AA, .."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i)
    state = F.aggregate(
        digits, F.struct(index.cast("int").alias("rest"), F.lit("").alias("text")),
        lambda s, _: F.when(s["rest"] < 0, s).otherwise(F.struct(
            (F.floor(s["rest"] / 26) - 1).cast("int").alias("rest"),
            F.concat(F.chr(F.lit(65) + F.pmod(s["rest"], F.lit(26))), s["text"]).alias("text"))),
        lambda s: s["text"])
    return state
