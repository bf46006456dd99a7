"""Answer checks: required text, cited sources, abstention, private tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.functions.text import collapse, fold_case


def contains_all(text: Column, wanted: Column) -> Column:
    """Every wanted string occurs, case aside; an empty list holds."""
    folded = fold_case(text)
    return F.forall(F.coalesce(wanted, F.array().cast("array<string>")), lambda w: F.contains(folded, fold_case(w)))


def free_of(text: Column, forbidden: list[str]) -> Column:
    """No private token occurs in the serialised output."""
    tokens = F.array(*[F.lit(token) for token in forbidden])
    folded = fold_case(text)
    return ~F.exists(tokens, lambda token: F.contains(folded, fold_case(token)))


def score_public(answers: DataFrame, forbidden: list[str]) -> DataFrame:
    """question_id, the four criteria and passed.

    ``answers``: question_id, answer, insufficient, cited (array), expected (array),
    expected_sources (array), allow_abstain, output (the serialised response).
    """
    missing = F.size(F.array_except(F.coalesce("expected_sources", F.array().cast("array<string>")),
                                    F.coalesce("cited", F.array().cast("array<string>")))) == 0
    checks = answers.select(
        "question_id", contains_all(F.col("answer"), F.col("expected")).alias("text_present"),
        missing.alias("sources_cited"),
        (F.col("insufficient") == F.coalesce("allow_abstain", F.lit(False))).alias("abstention_correct"),
        free_of(F.col("output"), forbidden).alias("privacy_passed"))
    return checks.withColumn("passed", F.col("text_present") & F.col("sources_cited") & F.col("abstention_correct")
                             & F.col("privacy_passed"))


def answer_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
                      F.count_if("privacy_passed").alias("privacy_passed"))


def assess_archive(answers: DataFrame, known_ids: DataFrame) -> DataFrame:
    """question_id, passed, evidence_pass, coverage_complete, missing_evidence.

    ``answers``: question_id, answer, insufficient, abstain, required (array), evidence (array of
    document_id, quote), source_ids (array), complete. ``known_ids``: document_id.
    """
    normal = fold_case(collapse(F.col("answer")))
    missing = F.filter("required", lambda w: ~F.contains(normal, fold_case(w)))
    lost = F.filter("evidence", lambda e: ~F.contains(normal, fold_case(e["quote"]))
                    | ~F.array_contains("source_ids", e["document_id"]))
    cited = answers.select("question_id", F.explode("source_ids").alias("document_id"))
    foreign = cited.join(known_ids.select("document_id"), "document_id", "left_anti").select("question_id").distinct()
    flagged = answers.join(foreign.withColumn("_foreign", F.lit(True)), "question_id", "left")
    evidence = ((F.size(missing) == 0) & (F.size(lost) == 0) & F.col("_foreign").isNull()
                & (F.col("insufficient") == F.col("abstain")) & ((F.size("source_ids") > 0) != F.col("abstain")))
    return flagged.select(
        "question_id", (evidence & F.col("complete")).alias("passed"), evidence.alias("evidence_pass"),
        F.col("complete").alias("coverage_complete"), F.size(lost).cast("bigint").alias("missing_evidence"))
