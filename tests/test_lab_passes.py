"""Laboratory lines are derived once: no second pass for issues, dates or expected facts."""

from pyspark.sql import functions as F

from foliarc.functions.numbers import parse_result
from foliarc.operators import lab

HEAD = "Test | Result | Unit | Reference\n"
REPORTS = [
    ("plain", "Laboratory report\nResult date: 2024-01-02\n" + HEAD + "A | 1,5 | mg | 0-2\nB | n/a | mg | 0-2\n\nremark"),
    ("conflict", "\n \nLaboratory report\r\nResult date: 2024-01-02\nResult date: 2024-01-03\n" + HEAD + "A | <2 | mg | 0-2\n"),
    ("invalid", "Laboratory report\nStudy: x\nResult date: 02.1997\nSpecimen date: 2024-01-02\n" + HEAD + "A | 3 | mg | 0-2\n"),
    ("study", "Laboratory report\nДата исследования: 05.03.2024\n" + HEAD + "A | positive | g | 0\n"),
    ("other", "Letter\nLaboratory report\nResult date: 2024-01-02\n")]


def lines_of(spark):
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.lit("  \n").alias("text")),
                    F.struct(F.lit(2).alias("page_number"), F.col("text").alias("text")))
    docs = spark.createDataFrame(REPORTS, "document_id string, text string").select("document_id", pages.alias("pages"))
    return docs, lab.annotated_lines(docs)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_summary_is_one_aggregate_with_the_issues_of_the_list(spark):
    _, lines = lines_of(spark)
    summary = lab.lab_summary(lines)
    assert joins(summary) == 0
    listed = {r[0]: r[1] for r in lab.lab_issues(lines).filter("code <> 'UNSUPPORTED_CONTENT'").groupBy("document_id").count().collect()}
    found = {r["document_id"]: r["unresolved"] for r in summary.collect()}
    assert found == {d: listed.get(d, 0) for d in ("plain", "conflict", "invalid", "study")}


def test_dated_rows_agree_with_dates_and_issues(spark):
    _, lines = lines_of(spark)
    one = lab.project_lab_facts(lab.dated_rows(lines))
    assert joins(one) == 0
    two = lab.project_lab_facts(lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_issues(lines))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {r["document_id"]: str(r["event_date"]) for r in one.collect()} == {
        "plain": "2024-01-02", "conflict": "None", "invalid": "None", "study": "2024-03-05"}


def test_expected_facts_come_without_a_join_by_row(spark):
    docs, lines = lines_of(spark)
    rows, dates, issues = lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_issues(lines)
    facts = lab.project_lab_facts(rows, dates, issues).localCheckpoint()
    broken = lab.validate_lab(rows, dates, lab.lab_subjects(lines), issues, facts, docs)
    assert broken.count() == 0
    # Pages, subjects, event dates with their anti join and stored facts; pages of dates; facts without a row.
    assert joins(broken) <= 7
    wrong = facts.withColumn("value_number", F.lit(7.0))
    found = lab.validate_lab(rows, dates, lab.lab_subjects(lines), issues, wrong, docs)
    assert {(r["document_id"], r["code"]) for r in found.collect()} == {(d, "PROJECTION") for d in ("plain", "conflict", "invalid", "study")}


def test_result_is_matched_once(spark):
    plan = spark.range(1).select(parse_result(F.concat(F.col("id").cast("string"), F.lit(",50")))  .alias("r"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("[eE][+-]") <= 3
    assert plan.first()["r"].asDict() == {"raw": "0,50", "kind": "NUMERIC", "comparator": "=", "numeric_value": "0.50"}


def test_rows_facts_and_dates_are_exchanged_once_by_document(spark):
    docs, lines = lines_of(spark)
    frames = [f.localCheckpoint() for f in (lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_subjects(lines), lab.lab_issues(lines))]
    facts = lab.project_lab_facts(frames[0], frames[1], frames[3]).localCheckpoint()
    plan = lab.validate_lab(*frames, facts, docs.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("),")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert not any("row_index" in k or "start_byte" in k for k in keys)
    assert sum("REPARTITION_BY_NUM" in line for line in plan.splitlines()) == 1
    assert plan.count("Exchange hashpartitioning") <= 6  # the mixed rows, pages, subjects, dates by document; conflicts and their documents


def test_odd_keys_of_rows_and_facts(spark):
    docs, lines = lines_of(spark)
    rows, dates, subjects, issues = lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_subjects(lines), lab.lab_issues(lines)
    facts = lab.project_lab_facts(rows, dates, issues)
    nameless = lambda frame: frame.withColumn("row_index", F.when(F.col("document_id") != "plain", F.col("row_index")))
    twice = facts.unionByName(facts.filter("document_id = 'study'"))
    known = docs.filter("document_id <> 'conflict'")

    def codes(*given):
        return sorted((r["document_id"], r["row_index"], r["code"]) for r in lab.validate_lab(*given).collect())

    assert codes(nameless(rows), dates, subjects, issues, nameless(facts), docs) == [("plain", None, "EXTRA_FACT"), ("plain", None, "PROJECTION")]
    assert codes(rows, dates, subjects, issues, twice, known) == [("study", 1, "DUPLICATE_SPAN")] * 2
    assert codes(rows.filter("document_id <> 'conflict'"), dates, subjects, issues, facts, known) == [("conflict", 1, "EXTRA_FACT")]
