"""Patterns and candidates that large tables meet often are looked at once, with the same results."""

from pyspark.sql import functions as F

from foliarc.functions import text as tx
from foliarc.operators import scoring

OLD = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def test_space_class_holds_the_same_characters_in_few_tests(spark):
    c = spark.createDataFrame([(chr(i),) for i in range(0x11000) if not 0xD800 <= i <= 0xDFFF], "c string")
    wrong = c.filter((F.col("c").rlike(f"^{tx.SPACE}\\z") != F.col("c").rlike(f"^[{OLD}]\\z"))
                     | (F.col("c").rlike(f"^{tx.NON_SPACE}\\z") != F.col("c").rlike(f"^[^{OLD}]\\z")))
    assert wrong.count() == 0
    assert c.filter(F.col("c").rlike(f"^{tx.SPACE}\\z")).count() == len(set(tx.SPACE_CHARS))
    assert r"\s" not in tx.SPACE and r"\s" not in tx.NON_SPACE


LAB = "case string, idx string, test string, kind string, comparator string, value string, unit string, reference string, dates string, subject string, page int"


def test_lab_candidates_are_judged_in_one_join(spark):
    def row(case, idx, test, value, unit="mg"):
        return (case, idx, test, "NUMERIC", "=", value, unit, "0-5", "", "UNKNOWN", 1)

    gold = [row("a", "g1", "Iron", "1.0"), row("a", "g2", " iron ", "2.0"), row("a", "g3", "Zinc", "3"), row("b", "g1", "Iron", "4"), row("c", "g1", "Salt", "5")]
    found = [row("a", "p1", "IRON", "2,0"), row("a", "p2", "Iron", "1,0"), row("a", "p3", "Zinc", "9"), row("a", "p4", "iron", "7"), row("b", "p1", "Iron", "4", "g"),
             row("d", "p1", "Lead", "1")]
    g = spark.createDataFrame(gold, LAB).withColumn("result", F.col("value"))
    p = spark.createDataFrame(found, LAB).withColumn("source_text", F.concat_ws(" | ", "test", F.translate("value", ",", ".")))
    parts = scoring.score_lab(g, p)
    # g1 and g2 differ in case and form only: each takes its own value, p4 is left over.
    assert {tuple(r) for r in parts["pairs"].select("case", "gold_idx", "pred_idx").collect()} == {
        ("a", "g1", "p2"), ("a", "g2", "p1"), ("a", "g3", "p3"), ("b", "g1", "p1")}
    assert {tuple(r) for r in parts["totals"].select("case", "tp", "fp", "fn", "critical").collect()} == {
        ("a", 2, 2, 1, 1), ("b", 0, 1, 1, 1), ("c", 0, 0, 1, 0), ("d", 0, 1, 0, 0)}
    values = {(r["case"], r["field"]): r["tp"] for r in parts["fields"].collect()}
    assert (values["b", "unit"], values["b", "value"], values["c", "value"], values["d", "value"]) == (0, 1, 0, 0)
    assert joins(parts["totals"]) == 0 and joins(parts["fields"]) == 1


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_refused_consultations_are_not_redacted(spark, monkeypatch):
    from foliarc.operators import consult

    docs = spark.createDataFrame([(1, "One", None, "READY", 1), (2, "Two", None, "FAILED", 1), (3, "Three", None, "READY", 1)],
                                 "document_id long, title string, deleted_at timestamp, status string, text_version int").selectExpr(
        "*", "DATE'2024-01-02' AS document_date", "1 AS generation")
    texts = spark.createDataFrame([(d, 1, f"t{d}", f"Text {d}, mail a{d}@b.org") for d in (1, 2, 3)],
                                  "document_id long, version int, text_revision_id string, content string")
    facts = spark.createDataFrame([(1, "f1", True, "CONFIRMED", "iron", "low", 2.0, "mg", 5), (3, "f2", True, "UNREVIEWED", "zinc", "x", None, None, 5)],
                                  "document_id long, fact_id string, active boolean, review_status string, name string, value_text string, value_number double, "
                                  "unit string, created_at long")
    asked = spark.createDataFrame([("ok", "q", [3, 1]), ("bad", "q", [1, 2]), ("many", "q", [1, 2, 3]), ("none", "q", []), ("null", "q", None)],
                                  "consultation_id string, question string, document_ids array<long>")
    cited = spark.createDataFrame([("ok", 3, 0, "  ")], "consultation_id string, document_id long, ord int, text string")
    seen = []
    plain = consult.redact
    monkeypatch.setattr(consult, "redact", lambda p, *a, **k: (seen.extend(r[0] for r in p.select("package_id").collect()), plain(p, *a, **k))[1])
    done = {r["consultation_id"]: r for r in consult.prepare_consultations(asked, docs, texts, facts, cited, max_documents=2).collect()}
    assert {k: r["code"] for k, r in done.items()} == {
        "ok": None, "bad": "SOURCE_UNAVAILABLE", "many": "CONTEXT_LIMIT", "none": "INSUFFICIENT_CONTEXT", "null": "INSUFFICIENT_CONTEXT"}
    assert done["ok"]["content"].endswith("Medical date: 2024-01-02\nText 3, mail [EMAIL]\n\n---\n\nMedical date: 2024-01-02\nText 1, mail [EMAIL]\nUSER CONFIRMED iron low 2 mg")
    assert [r["document_id"] for r in done["bad"]["source_refs"]] == [1, 2] and done["none"]["source_refs"] is None
    assert seen == ["ok"]
    cut = {r["consultation_id"]: r["warnings"] for r in consult.prepare_consultations(
        asked, docs, texts, facts, cited, text_chars=4, budget=60).collect()}
    assert cut["ok"] == ["DOCUMENT_TRUNCATED:3", "DOCUMENT_OMITTED:1"] and cut["none"] == []


def test_reader_fields_are_compared_without_a_row_per_field(spark):
    from foliarc.operators import lab

    rows = [("a", "x", 1, "Iron", "1", "mg", None), ("a", "y", 1, " Iron ", "2", "g", None), ("a", "z", 1, "Iron", "1", "mg", "0-5"),
            ("b", "x", 1, "Zinc", "1", "mg", "0"), ("b", "x", 2, "Zinc", "1", "mg", "0"), ("b", "y", 1, "Salt", "1", "mg", "0"), ("c", "x", 1, "A  b", "1", "mg", "0")]
    readers = spark.createDataFrame(rows, "document_id string, channel string, row int, test string, result string, unit string, reference string")
    origins = spark.createDataFrame([("a", "NATIVE"), ("b", "NATIVE"), ("c", "NATIVE")], "document_id string, text_layer_origin string")
    decisions, issues = lab.reconcile_readers(readers, origins)
    assert sorted(tuple(r) for r in issues.filter("row IS NOT NULL").collect()) == [("a", 1, "result"), ("a", 1, "unit")]
    assert [tuple(r) for r in issues.filter("row IS NULL").collect()] == [("b", None, "row_count")]
    assert {r["document_id"]: (r["decision"], r["issues"]) for r in decisions.collect()} == {
        "a": ("REVIEW_CONFLICT", 2), "b": ("REVIEW_ALIGNMENT", 1), "c": ("REVIEW_INSUFFICIENT", 0)}
    # The list of readings is not unpivoted before it is compared.
    assert "map_from_entries" not in issues._jdf.queryExecution().optimizedPlan().toString()


def test_spans_of_encoded_pages_are_those_of_the_page(spark):
    from foliarc.operators import blocks

    spans = spark.createDataFrame([("aä\tb", a, b) for a in range(-1, 7) for b in range(-1, 7)] + [(None, 0, 1)], "t string, a int, b int")
    same = spans.filter(tx.bytes_text(F.encode("t", "UTF-8"), F.col("a"), F.col("b")).eqNullSafe(tx.span_text(F.col("t"), F.col("a"), F.col("b"))))
    assert same.count() == spans.count()
    text = "\n\n".join(f"Line {i} of  a\ttext with ä" for i in range(300))
    docs = spark.createDataFrame([("d", "v", [(1, text), (2, "\n\n")]), ("e", "v", [(1, "")])],
                                 "document_id string, parser_version string, pages array<struct<page_number:int,text:string>>")
    ir = blocks.build_blocks(docs)
    assert {r[0]: r[1] for r in blocks.verify_blocks(ir).collect()} == {"d": [], "e": []}
    rows = blocks.block_rows(ir).filter("document_id = 'd' AND page_index = 0").orderBy("block_order").collect()
    assert "".join(r["text"] for r in rows) == text and len(rows) == 599
    moved = ir.withColumn("blocks", F.transform("blocks", lambda b: b.withField("normalizedText", F.concat(b["normalizedText"], F.lit("x")))))
    assert {tuple(r[1]) for r in blocks.verify_blocks(moved).filter("document_id = 'd'").collect()} == {("IR_HASH", "REBUILD", "MAPPING")}


def test_scored_sides_meet_without_what_no_check_reads(spark, monkeypatch):
    rows = [("a", "1", "Iron", None, "mg"), ("a", "2", "Zinc", "1,0", " MG"), ("b", "1", "Salt", "x", None)]
    base = spark.createDataFrame(rows, "case string, idx string, test string, value string, unit string").selectExpr(
        "*", "'NUMERIC' AS kind", "'=' AS comparator", "'0-5' AS reference", "'' AS dates", "'UNKNOWN' AS subject", "1 AS page", "'never read' AS note")
    g = base.withColumn("result", F.lit("1"))
    p = base.withColumn("source_text", F.concat("test", F.lit(" 1"))).withColumn("value", F.translate("value", ",", ".")).withColumn(
        "unit", F.when(F.col("unit") == " MG", "mg").otherwise(F.col("unit")))
    plans, kept = [], scoring.durable
    monkeypatch.setattr(scoring, "durable", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, *a))[1])
    totals = scoring.score_lab(g, p)["totals"]
    # NULL numbers and units agree, as do values in another form.
    assert {tuple(r) for r in totals.select("case", "tp", "fp", "fn", "critical").collect()} == {("a", 2, 0, 0, 0), ("b", 1, 0, 0, 0)}
    assert "struct" not in plans[0] and "0-5" not in plans[0].split("Join", 1)[1]
