"""Run series: scheduled summaries, case stability, run comparisons and benchmark aggregates.

``plan``: run, group, place. ``cases``: case, place. ``results``: run, case, place, passed and
criteria. ``stages``: run, case, stage, fingerprint. ``calls``: run, case, position, task,
input_hash, output_hash, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.session import fits_broadcast

CRITERIA = ["text_present", "sources_cited", "abstention_correct", "privacy_passed"]


def accepted_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results of runs whose cases are a prefix of the case list; others are not evidence."""
    listed = results.join(cases.select("case", F.col("place").alias("_place")), "case", "left")
    good = listed.groupBy("run").agg(
        F.bool_and(F.coalesce(F.col("place") == F.col("_place"), F.lit(False))).alias("ordered"),
        F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.countDistinct("case").alias("d"))
    return results.join(good.filter("ordered AND n = d AND last = n - 1").select("run"), "run", "left_semi")


def series_summary(plan: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per group; every scheduled run stays in the denominator."""
    total = cases.agg(F.count(F.lit(1)).alias("case_count")).withColumn("one", F.lit(1))
    per_run = accepted_results(results, cases).groupBy("run").agg(
        F.count_if("passed").alias("score"), F.count(F.lit(1)).alias("observed"),
        F.count_if(F.col("passed") & (F.col("place") < 10)).alias("first_ten"))
    runs = plan.join(per_run, "run", "left").na.fill(0, ["score", "observed", "first_ten"]).withColumn(
        "one", F.lit(1)).join(F.broadcast(total), "one")
    complete = F.col("observed") == F.col("case_count")
    return runs.groupBy("group").agg(
        F.count(F.lit(1)).alias("scheduled_runs"), F.count_if(complete).alias("completed_runs"),
        F.min("score").alias("min"), F.median("score").alias("median"), F.max("score").alias("max"),
        F.bool_and(complete & (F.col("first_ten") == 10) & (F.col("case_count") >= 10)).alias("first_ten_every_run"),
        F.bool_and(complete & (F.col("score") == F.col("case_count"))).alias("all_passed_every_run"))


def case_stability(plan: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per group and case: pass counts, status and criteria counts."""
    scheduled = plan.groupBy("group").agg(F.count(F.lit(1)).alias("scheduled"))
    have = accepted_results(results, cases).join(plan.select("run", "group"), "run")
    seen = have.groupBy("group", "case").agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("observed"),
        *[F.count_if(c).alias(c) for c in CRITERIA if c in results.columns])
    listed = cases.select("case", F.lit(1).alias("one"))
    listed = F.broadcast(listed) if fits_broadcast(listed, 64) else listed
    grid = scheduled.withColumn("one", F.lit(1)).join(listed, "one").drop("one")
    rows = grid.join(seen, ["group", "case"], "left").na.fill(0)
    status = (F.when(F.col("observed") < F.col("scheduled"), F.lit("missing"))
              .when(F.col("passed") == F.col("scheduled"), F.lit("always-pass"))
              .when(F.col("passed") == 0, F.lit("always-fail")).otherwise(F.lit("unstable")))
    return rows.withColumn("status", status)


def error_types(plan: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """group, case, error_type, n; a scheduled run without a result counts as MISSING_RESULT."""
    have = accepted_results(results, cases).join(plan.select("run", "group"), "run")
    errors = have.filter(F.col("error_type").isNotNull()).groupBy("group", "case", "error_type").agg(
        F.count(F.lit(1)).alias("n"))
    gaps = case_stability(plan, results, cases).filter(F.col("observed") < F.col("scheduled")).select(
        "group", "case", F.lit("MISSING_RESULT").alias("error_type"),
        (F.col("scheduled") - F.col("observed")).alias("n"))
    return errors.unionByName(gaps)


def stage_variants(plan: DataFrame, stages: DataFrame) -> DataFrame:
    """group, case, stage, variants: distinct fingerprints over the runs."""
    return stages.join(plan.select("run", "group"), "run").groupBy("group", "case", "stage").agg(
        F.countDistinct("fingerprint").alias("variants"))


def reference_runs(plan: DataFrame) -> DataFrame:
    """group, reference: the first scheduled run of each group."""
    return plan.groupBy("group").agg(F.min_by("run", F.struct("place", "run")).alias("reference"))


def changed_stages(plan: DataFrame, stages: DataFrame) -> DataFrame:
    """group, run, case, stage where a run differs from its group's reference run."""
    members = plan.join(reference_runs(plan), "group")
    ref = stages.join(members.filter("run = reference").select("group", "run"), "run").select(
        "group", "case", "stage", F.col("fingerprint").alias("want"))
    got = stages.join(members.filter("run <> reference").select("group", "run"), "run")
    known = ref.select("group", "case").distinct()
    pairs = got.join(known, ["group", "case"], "left_semi").select("group", "run", "case").distinct()
    wanted = pairs.join(ref, ["group", "case"])
    both = wanted.join(got.select("group", "run", "case", "stage", F.col("fingerprint").alias("got")),
                       ["group", "run", "case", "stage"], "full_outer")
    kept = both.join(pairs, ["group", "run", "case"], "left_semi")
    return kept.filter(~F.col("want").eqNullSafe(F.col("got"))).select("group", "run", "case", "stage")


def first_call_difference(plan: DataFrame, calls: DataFrame) -> DataFrame:
    """group, run, case, position, kind of the first call that differs from the reference run."""
    members = plan.join(reference_runs(plan), "group")
    row = F.struct("task", "input_hash", "output_hash", "error")
    side = calls.select("run", "case", "position", row.alias("call"))
    ref = side.join(members.filter("run = reference").select("group", "run"), "run").select(
        "group", "case", "position", F.col("call").alias("want"))
    got = side.join(members.filter("run <> reference").select("group", "run"), "run")
    pairs = got.select("group", "run", "case").distinct().join(ref.select("group", "case").distinct(), ["group", "case"])
    both = pairs.join(ref, ["group", "case"]).join(
        got.select("group", "run", "case", "position", F.col("call").alias("got")),
        ["group", "run", "case", "position"], "full_outer").join(pairs, ["group", "run", "case"], "left_semi")
    kind = (F.when(F.col("want").isNull() | F.col("got").isNull(), F.lit("call-count"))
            .when(~F.col("want.task").eqNullSafe(F.col("got.task")), F.lit("operation-order"))
            .when(~F.col("want.input_hash").eqNullSafe(F.col("got.input_hash")), F.lit("input"))
            .when(~F.col("want").eqNullSafe(F.col("got")), F.lit("output-or-error")))
    differing = both.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return differing.groupBy("group", "run", "case").agg(
        F.min("position").alias("position"), F.min_by("kind", "position").alias("kind"))


def repeated_inputs(plan: DataFrame, calls: DataFrame) -> DataFrame:
    """group, task, input_hash, observations, outcomes of inputs seen more than once."""
    joined = calls.join(plan.select("run", "group"), "run")
    outcome = F.struct(F.coalesce("output_hash", F.lit("")), F.coalesce("error", F.lit("")))
    return joined.groupBy("group", "task", "input_hash").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct(outcome).alias("outcomes")).filter("observations > 1")


def provider_consistency(plan: DataFrame, calls: DataFrame) -> DataFrame:
    return repeated_inputs(plan, calls).groupBy("group").agg(
        F.count(F.lit(1)).alias("repeated_inputs"), F.count_if(F.col("outcomes") > 1).alias("variable_inputs"))


def stable_results(results: DataFrame) -> DataFrame:
    """One row: cases with one outcome over all runs, one answer without errors, and passes in every run.

    ``results``: run, case, evidence_pass, answer_hash, error.
    """
    runs = results.agg(F.countDistinct("run").alias("runs")).withColumn("one", F.lit(1))
    per_case = results.groupBy("case").agg(
        F.count(F.lit(1)).alias("n"), (F.min("evidence_pass") == F.max("evidence_pass")).alias("same"),
        (F.min("answer_hash") == F.max("answer_hash")).alias("same_answer"), F.count("error").alias("errors"),
        F.bool_and("evidence_pass").alias("all_pass")).withColumn("one", F.lit(1)).join(F.broadcast(runs), "one")
    full = F.col("n") == F.col("runs")
    return per_case.agg(
        F.count_if(F.col("same") & full).alias("stable_results"),
        F.count_if(F.col("same_answer") & full & (F.col("errors") == 0)).alias("stable_answers"),
        F.count_if(F.col("all_pass") & full).alias("all_runs_pass"), F.count(F.lit(1)).alias("case_count"))


def benchmark_runs(results: DataFrame, expected_cases: int | None = None) -> DataFrame:
    """Content-free totals per run with completeness."""
    per = results.groupBy("run").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.count_if("evidence_pass").alias("evidence_pass"), F.round(F.sum("seconds"), 2).alias("seconds"))
    if expected_cases is None:
        most = per.agg(F.max("total").alias("expected")).withColumn("one", F.lit(1))
        per = per.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").drop("one")
    else:
        per = per.withColumn("expected", F.lit(expected_cases))
    return per.withColumn("complete", F.col("total") == F.col("expected"))


def repeat_stability(rows: DataFrame, case: str, repeat: str, fields: list[str]) -> DataFrame:
    """case, repeats, variants: distinct order-free contents of a case over its repeats.

    Each repeat is reduced to the count and two independent sums of row hashes.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields])
    hashed = rows.select(case, repeat, F.sha2(row, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25, 37)]
    per = hashed.groupBy(case, repeat).agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return per.groupBy(case).agg(F.count(F.lit(1)).alias("repeats"),
                                 F.countDistinct("n", "p0", "p1", "p2", "p3").alias("variants"))
