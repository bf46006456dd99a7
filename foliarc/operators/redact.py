"""Redaction of packages of fields and the application of proposed identifier spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions import redaction as r
from foliarc.functions.text import fold_case, letters, span_pattern, strip
from foliarc.session import durable


def _or_blocked(check: Column) -> Column:
    """A check that comes out NULL blocks."""
    return F.coalesce(check, F.lit(True))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def redact(packages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """package_id, texts, code from package_id, fields (array of text), identifier_context.

    Ordered rules run on every field with names and labelled values of the whole package. ``code``
    is NULL for a clean package. A package is blocked, with NULL texts, if its fields or any of
    them is NULL, if a check cannot be decided, if it is ambiguous, if its clinical content would
    change, or if it exceeds ``max_chars`` (no limit unless one is given).
    """
    whole = F.concat(F.coalesce("identifier_context", F.lit("")), F.lit("\n"), F.array_join("fields", "\n"))
    size = F.aggregate("fields", F.lit(0), lambda total, f: total + F.length(f))
    prepared = packages.withColumn("_context", whole).withColumn("_size", size).withColumn(
        "_ids", r.numeric_identifiers(F.col("_context"))).withColumn("_names", r.package_names(F.col("_context")))
    cleaned = prepared.withColumn("_clean", F.transform("fields", lambda f: r.sanitize_field(f, F.col("_names"))))
    collision = F.exists("fields", lambda f: r.identifier_collision(f, F.col("_ids")))
    changed = F.exists(F.arrays_zip(F.col("fields").alias("a"), F.col("_clean").alias("b")), lambda z: ~_same(z["a"], z["b"]) & ~(
        _same(r.protected_values(z["a"]), r.protected_values(z["b"])) & _same(r.negations(z["a"]), r.negations(z["b"]))))
    unreadable = F.col("fields").isNull() | F.exists("fields", lambda f: f.isNull())
    too_long = F.lit(False) if max_chars is None else F.col("_size") > max_chars
    code = (F.when(_or_blocked(unreadable) | _or_blocked(too_long), F.lit("PRIVACY_CHECK_FAILED"))
            .when(_or_blocked(collision) | _or_blocked(changed), F.lit("CLINICAL_CONTENT_CHANGED")))
    coded = cleaned.withColumn("code", code)
    return coded.select("package_id", F.when(F.col("code").isNull(), F.col("_clean")).alias("texts"), "code",
                        F.col("_context").alias("context"))


def check_proposals(spans: DataFrame, max_spans: int | None = None, max_length: int | None = None) -> DataFrame:
    """package_id, invalid: whether a package's proposals leave the agreed form.

    A proposal names a listed category and a non-blank text; ``max_spans`` and ``max_length`` bound
    their number and size where given.
    """
    listed = F.coalesce(F.col("category").isin(vocab.IDENTIFIER_CATEGORIES), F.lit(False))
    shaped = F.coalesce(F.length(strip(F.col("text"))) > 0, F.lit(False))
    if max_length is not None:
        shaped &= F.length("text") <= max_length
    many = F.lit(False) if max_spans is None else F.count(F.lit(1)) > max_spans
    return spans.groupBy("package_id").agg((F.bool_or(~(listed & shaped)) | many).alias("invalid"))


def judge_spans(packages: DataFrame, spans: DataFrame) -> DataFrame:
    """package_id, ord, text, category, verdict of proposed identifier spans.

    Verdicts: REPLACE, PLACEHOLDER (already masked), OUTSIDE, BAD_PLACEHOLDER, CLINICAL, UNSAFE.
    """
    joined = spans.join(packages.select("package_id", "texts"), "package_id")
    span = F.col("text")
    whole_word = F.exists("texts", lambda t: F.call_function("rlike", t, span_pattern(span)))
    clinical = (F.size(r.plain_numbers(span)) > 0) | (F.size(r.negations(span)) > 0)
    unsafe = (F.length(strip(span)) < 3) | fold_case(strip(span)).isin(vocab.NAME_STOPLIST) | ~whole_word
    verdict = (
        F.when(~F.exists("texts", lambda t: F.contains(t, span)), F.lit("OUTSIDE"))
        .when(r.is_placeholder(span), F.lit("PLACEHOLDER"))
        .when(clinical, F.lit("CLINICAL")).when(unsafe, F.lit("UNSAFE")).otherwise(F.lit("REPLACE")))
    strict_only = F.startswith(span, F.lit("[")) & ~r.is_placeholder(span)
    return joined.select("package_id", "ord", "text", "category", verdict.alias("verdict"),
                         strict_only.alias("bad_placeholder"))


def span_labels(packages: DataFrame, judged: DataFrame) -> DataFrame:
    """package_id, text, label: lettered placeholders per category, skipping labels already used."""
    used = packages.select("package_id", F.explode(F.array_distinct(F.flatten(F.transform(
        "texts", lambda t: F.regexp_extract_all(t, F.lit(r"\[([A-Z]+_[A-Z]+)\]"), 1))))).alias("used"))
    taken = used.groupBy("package_id").agg(F.collect_set("used").alias("taken"))
    first = judged.filter("verdict = 'REPLACE'").groupBy("package_id", "text").agg(
        F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"))
    order = W.partitionBy("package_id", "category").orderBy("ord")
    numbered = first.withColumn("n", F.row_number().over(order) - 1).join(taken, "package_id", "left")
    # The n-th free letter of a category: used letters are few, so a short list of candidates holds it.
    prefix = F.concat(F.col("category"), F.lit("_"))
    busy = F.size(F.filter(F.coalesce("taken", F.array().cast("array<string>")), lambda t: F.startswith(t, prefix)))
    options = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") + busy), lambda i: F.concat(prefix, letters(i))),
                       lambda c: ~F.coalesce(F.array_contains("taken", c), F.lit(False)))
    return numbered.select("package_id", "text", F.concat(F.lit("["), F.get(options, F.col("n")), F.lit("]")).alias("label"))


def apply_identifier_spans(packages: DataFrame, spans: DataFrame, strict: bool = False,
                           model_warnings: DataFrame | None = None, max_spans: int | None = None,
                           max_length: int | None = None) -> DataFrame:
    """package_id, texts, code, warnings after proposed spans replaced whole words of redacted packages.

    A package with a proposal outside the agreed form (:func:`check_proposals`) is blocked whole.

    ``packages``: the result of :func:`redact`; ``spans``: package_id, ord, text, category. Strict mode
    blocks a package on any span that cannot be applied; lenient mode leaves it and warns.
    """
    # Four branches read the redacted texts; the rules run once.
    packages = durable(packages)
    refused = check_proposals(spans, max_spans, max_length).filter("invalid").select("package_id")
    clean = packages.filter(F.col("code").isNull())
    judged = judge_spans(clean, spans.join(refused, "package_id", "left_anti"))
    labels = span_labels(clean, judged).groupBy("package_id").agg(
        F.sort_array(F.collect_list(F.struct(F.length("text").alias("n"), F.col("text").alias("k"),
                                             F.col("label").alias("v"))), asc=False).alias("labels"))
    problems = judged.groupBy("package_id").agg(
        F.bool_or(F.col("verdict").isin("OUTSIDE", "CLINICAL", "UNSAFE") | F.col("bad_placeholder")).alias("unusable"),
        F.bool_or(F.col("verdict") == "CLINICAL").alias("clinical"), F.bool_or(F.col("verdict") == "UNSAFE").alias("unsafe"))
    none = F.array().cast("array<struct<n:int,k:string,v:string>>")
    joined = clean.join(labels, "package_id", "left").join(problems, "package_id", "left").join(
        refused.withColumn("refused", F.lit(True)), "package_id", "left").withColumn("labels", F.coalesce("labels", none))
    if model_warnings is not None:
        noted = model_warnings.select("package_id").distinct().withColumn("noted", F.lit(True))
        joined = joined.join(noted, "package_id", "left")
    else:
        joined = joined.withColumn("noted", F.lit(None).cast("boolean"))

    def replace_all(text: Column) -> Column:
        return F.aggregate("labels", text, lambda current, p: F.call_function(
            "regexp_replace", current, span_pattern(p["k"]), p["v"]))

    named = joined.withColumn("_names", r.package_names(F.col("context")))
    replaced = named.withColumn("_out", F.transform("texts", lambda t: r.sanitize(replace_all(t), F.col("_names"))))
    changed = F.exists(F.arrays_zip(F.col("texts").alias("a"), F.col("_out").alias("b")), lambda z: ~_same(z["a"], z["b"]) & ~(
        _same(r.protected_values(z["a"]), r.protected_values(z["b"])) & _same(r.negations(z["a"]), r.negations(z["b"]))
        & _same(r.plain_numbers(z["a"]), r.plain_numbers(z["b"]))))
    blocked = F.coalesce("refused", F.lit(False)) | (F.coalesce(F.col("unusable"), F.lit(False)) & F.lit(strict))
    code = F.when(blocked, F.lit("PRIVACY_CHECK_FAILED")).when(_or_blocked(changed), F.lit("CLINICAL_CONTENT_CHANGED"))
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("clinical", F.lit(False)), F.lit("SPAN_WITH_NUMBERS_OR_NEGATION")),
        F.when(F.coalesce("unsafe", F.lit(False)), F.lit("SPAN_NOT_REPLACEABLE")),
        F.when(F.coalesce("noted", F.lit(False)), F.lit("QUASI_IDENTIFIERS"))))
    done = replaced.withColumn("_code", code).select(
        "package_id", F.when(F.col("_code").isNull(), F.col("_out")).alias("texts"), F.col("_code").alias("code"),
        warnings.alias("warnings"))
    rest = packages.filter(F.col("code").isNotNull()).select(
        "package_id", "texts", "code", F.array().cast("array<string>").alias("warnings"))
    return done.unionByName(rest)
