"""Printed results, decimals, dates and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.text import SPACE, fold_case, let, strip

RESULT_TYPE = "struct<raw:string,kind:string,comparator:string,numeric_value:string>"


def decimal_text(number: Column) -> Column:
    """Exact decimal string of a printed number: digits kept, exponent applied where short."""
    return let(number, _decimal_text)


def _decimal_text(number: Column) -> Column:
    sign = F.regexp_extract(number, r"^([+-]?)", 1)
    whole = F.regexp_extract(number, r"^[+-]?(\d+)", 1)
    fraction = F.regexp_extract(number, r"\.(\d+)", 1)
    # A failing try_cast costs an exception, so texts without a number never reach it.
    exponent = F.when(F.contains(number, F.lit("e")) | F.contains(number, F.lit("E")), F.coalesce(
        F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    bare = F.ltrim(F.concat(whole, fraction), F.lit("0"))
    parts = F.struct(
        F.when(bare == "", F.lit("0")).otherwise(bare).alias("digits"),
        (exponent - F.length(fraction)).alias("exp"),
        F.when(sign == "-", F.lit("-")).otherwise(F.lit("")).alias("sign"))

    def render(p: Column) -> Column:
        count = F.length(p["digits"])
        left = p["exp"] + count
        is_plain = (p["exp"] <= 0) & (left > -6)
        point = F.when(is_plain, left).otherwise(F.lit(1))
        body = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), p["digits"]))
            .when(point >= count, F.concat(p["digits"], F.repeat(F.lit("0"), point - count)))
            .otherwise(F.concat(F.substring(p["digits"], F.lit(1), point), F.lit("."),
                                F.substring(p["digits"], point + 1, count))))
        shift = left - point
        tail = F.when(is_plain | (shift == 0), F.lit("")).otherwise(
            F.concat(F.lit("E"), F.when(shift > 0, F.lit("+")).otherwise(F.lit("")), shift.cast("string")))
        return F.concat(p["sign"], body, tail)

    return let(parts, render)


def parse_result(raw: Column) -> Column:
    """Printed result as {raw, kind, comparator, numeric_value}; NULL when not understood."""

    pattern = "^" + vocab.RESULT + r"\z"

    def read(text: Column) -> Column:
        """Text, sign and number, each matched once; a text that is no number has the number NULL."""
        number = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
        return F.struct(text.alias("text"), F.regexp_extract(text, pattern, 1).alias("sign"),
                        F.translate(number, ",−", ".-").alias("number"))

    def decide(seen: Column) -> Column:
        text, sign, number = seen["text"], seen["sign"], seen["number"]
        finite = number.isNotNull() & F.coalesce(F.abs(number.try_cast("double")) < float("inf"), F.lit(False))
        comparator = (F.when(sign == "≤", F.lit("<=")).when(sign == "≥", F.lit(">="))
                      .when(sign == "", F.lit("=")).otherwise(sign))
        numeric = F.struct(text.alias("raw"), F.lit("NUMERIC").alias("kind"), comparator.alias("comparator"),
                           decimal_text(number).alias("numeric_value"))
        word = F.struct(text.alias("raw"), F.lit("QUALITATIVE").alias("kind"),
                        F.lit(None).cast("string").alias("comparator"),
                        F.lit(None).cast("string").alias("numeric_value"))
        return (F.when(finite, numeric.cast(RESULT_TYPE))
                .when(fold_case(text).isin(vocab.QUALITATIVE), word.cast(RESULT_TYPE)))

    return let(let(strip(raw), read), decide)


def decimal_value(text: Column) -> Column:
    """Number for comparison: comma or point, spaces ignored; NULL when invalid."""
    return F.translate(text.cast("string"), ", ", ".").try_cast("decimal(38,18)")


def iso_date(text: Column) -> Column:
    """Date of a strict YYYY-MM-DD text that names a real calendar day; otherwise NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def is_valid_date_or_null(text: Column) -> Column:
    return text.isNull() | iso_date(text).isNotNull()


def lab_date(value: Column) -> Column:
    """{iso, raw} of a printed report date with an optional time; NULL when partial or invalid."""

    def decide(candidate: Column) -> Column:
        original = F.regexp_extract(candidate, vocab.LAB_DATE_VALUE, 1)
        token = F.regexp_extract(original, r"^(\S+)", 1)
        clock = F.regexp_extract(original, f"{SPACE}(\\S+)$", 1)
        iso = F.when(token.contains("."), F.concat_ws("-", F.substring(token, 7, 4), F.substring(token, 4, 2),
                                                      F.substring(token, 1, 2))).otherwise(token)
        clock_ok = (clock == "") | clock.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$")
        return F.when((original != "") & clock_ok & iso_date(iso).isNotNull(),
                      F.struct(iso.alias("iso"), original.alias("raw")))

    return let(strip(value), decide)


def resolve_period(question: Column, start: Column, end: Column, today: Column) -> Column:
    """{date_from, date_to, violation}: explicit dates win, else a period named in the question."""
    none = F.lit(None).cast("date")
    year = F.year(today)
    named = F.when(question.rlike(vocab.PERIOD_NAMED_YEAR),
                   F.regexp_extract(question, vocab.PERIOD_NAMED_YEAR, 1).cast("int"))
    explicit = start.isNotNull() | end.isNotNull()
    previous = question.rlike(vocab.PERIOD_PREVIOUS_YEAR)
    recent = question.rlike(vocab.PERIOD_LAST_YEAR)
    date_from = (F.when(explicit, start)
                 .when(previous, F.make_date(year - 1, F.lit(1), F.lit(1)))
                 .when(recent, F.add_months(today, -12))
                 .when(named.isNotNull(), F.make_date(named, F.lit(1), F.lit(1))).otherwise(none))
    date_to = (F.when(explicit, end)
               .when(previous, F.make_date(year - 1, F.lit(12), F.lit(31)))
               .when(recent, today)
               .when(named.isNotNull(), F.make_date(named, F.lit(12), F.lit(31))).otherwise(none))
    return let(
        F.struct(date_from.alias("f"), date_to.alias("t")),
        lambda p: F.struct(p["f"].alias("date_from"), p["t"].alias("date_to"),
                           F.when(p["f"] > p["t"], F.lit("INVALID_PERIOD")).alias("violation")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded quotient; NULL on an empty denominator."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def nearest_rank(values: Column, q: float) -> Column:
    """Nearest-rank percentile of an array with half-even rounding of the rank."""
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    return let(ordered, lambda o: F.get(o, F.bround(F.lit(q) * (F.size(o) - 1)).cast("int")))
