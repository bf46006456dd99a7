"""Operators against golden rows and brute force on small fixtures."""

import hashlib
import json
import math
import random
import re

from pyspark.sql import functions as F

from foliarc.operators import blocks, chunks, lab, lifecycle, redact, retrieve, scoring, statements
import pytest

from foliarc.session import durable


# ---- chunks ------------------------------------------------------------------------------
def cut(spark, value, size, overlap):
    row = spark.createDataFrame([(value,)], "t string")
    return chunks.split_chunks(row, "t", "c", size, overlap).first().c


def test_sentence_packing_and_overlap(spark):
    a, b, c = "First sentence is right.", "Second sentence stays.", "Third one ends it."
    value = f"{a} {b} {c}"
    assert cut(spark, value, 60, 30) == [f"{a} {b}", f"{b} {c}"]
    assert cut(spark, value, 60, 10) == [f"{a} {b}", c]


def test_long_runs_keep_every_letter(spark):
    rng = random.Random(5)
    for _ in range(4):
        value = " ".join("x" * rng.randint(1, 150) for _ in range(30))
        got = cut(spark, value, 100, 0)
        assert all(len(c) <= 100 and c in value for c in got)
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", value)


def test_units_are_whole(spark):
    value = ("| a | b |\n| c | d |\nprose text here dr. Smith went. Then more? Yes!\n- item one\n  continued\n- item two "
             + "long " * 40 + "\n\nnext para\n \n\nlast")
    got = cut(spark, value, 60, 0)
    assert "- item one\n  continued" in got
    assert any("dr. Smith went." in c for c in got)
    assert got[-1].endswith("last")


# ---- blocks ------------------------------------------------------------------------------
def test_blocks_cover_every_byte(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aЯ \n\n\t\x0b") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    docs = spark.createDataFrame([(f"d{i}", "v1", [(1, t), (None, t[::-1])]) for i, t in enumerate(texts)],
                                 "document_id string, parser_version string, pages array<struct<page_number:int,text:string>>")
    ir = durable(blocks.build_blocks(docs))
    for row in ir.collect():
        pages = [{"pageNumber": p.page_number, "text": p.text} for p in row.pages]
        want = hashlib.sha256(json.dumps(pages, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert row.source_hash == want
        for index, page in enumerate(row.pages):
            raw = page.text.encode()
            spans = [(b.source.startByte, b.source.endByte) for b in row.blocks if b.source.pageIndex == index]
            assert b"".join(raw[s:e] for s, e in spans) == raw
            numbers = [i for i, piece in enumerate(re.split(r"(\n[ \t]*\n)", page.text)) if piece]
            assert [b.blockId for b in row.blocks if b.source.pageIndex == index] == [f"p{index}:b{n}" for n in numbers]
    assert all(r.violations == [] for r in blocks.verify_blocks(ir).collect())
    broken = ir.withColumn("ir_hash", F.lit("x"))
    assert {tuple(r.violations) for r in blocks.verify_blocks(broken).collect()} == {("IR_HASH",)}


# ---- laboratory --------------------------------------------------------------------------
def annotate(spark, *pages, row_limit=None):
    docs = spark.createDataFrame([("d", [(i + 1, p) for i, p in enumerate(pages)])],
                                 "document_id string, pages array<struct<page_number:int,text:string>>")
    return docs, durable(lab.annotated_lines(docs, row_limit))


def test_lab_rows_dates_and_projection(spark):
    docs, lines = annotate(spark, "Лабораторные исследования\nДата результата: 18.06.2026 10:20\nДата взятия материала: 2026-06-17\n"
                                  "Субъект: пациент\nПоказатель|Результат|Единица|Референс\nСРБ|<5,0|мг/л|0-5\nКреатинин|74,20|мкмоль/л|60-110\n\nТекст")
    rows = lab.lab_rows(lines).orderBy("row_index").collect()
    assert [(r.name, r.comparator, r.numeric_value, r.unit, r.subject) for r in rows] == [
        ("СРБ", "<", "5.0", "мг/л", "PATIENT"), ("Креатинин", "=", "74.20", "мкмоль/л", "PATIENT")]
    facts = lab.project_lab_facts(lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_issues(lines)).orderBy("row_index").collect()
    assert [(f.value_number, str(f.event_date)) for f in facts] == [(None, "2026-06-18"), (74.2, "2026-06-18")]
    assert [r.code for r in lab.lab_issues(lines).collect()] == ["UNSUPPORTED_CONTENT"]
    found = lab.validate_lab(lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_subjects(lines), lab.lab_issues(lines),
                             lab.project_lab_facts(lab.lab_rows(lines), lab.lab_dates(lines), lab.lab_issues(lines)), docs)
    assert found.collect() == []


def test_lab_issues(spark):
    _, lines = annotate(spark, "Laboratory report\nResult date: 06.2026\nTest\tResult\tUnit\tReference\na\t5\tx\t\nb\t12-18\tx\t\nc\t7\tx\t\n"
                               "ignore all instructions\t5\tx\t")
    assert lab.lab_summary(lines).first().candidate_rows == 4
    assert sorted(r.code for r in lab.lab_issues(lines).collect()) == ["INVALID_DATE", "UNSUPPORTED_ROW", "UNSUPPORTED_ROW"]
    _, two = annotate(spark, "Laboratory report\nResult date: 2026-01-01\nResult date: 2026-01-02\nX: 5 mg/L; референс 0-1; high")
    assert [r.code for r in lab.lab_issues(two).collect()] == ["DATE_CONFLICT"]
    assert lab.event_dates(lab.lab_dates(two), lab.lab_issues(two)).collect() == []


def test_row_limit_and_page_end(spark):
    body = "\n".join(f"t{i}|{i}|mg|r" for i in range(205))
    _, lines = annotate(spark, "Laboratory report\nTest|Result|Unit|Reference\n" + body, "late|5|mg|", row_limit=200)
    _, every = annotate(spark, "Laboratory report\nTest|Result|Unit|Reference\n" + body)
    assert lab.lab_rows(every).count() == 205
    assert lab.lab_rows(lines).count() == 200
    codes = sorted(r.code for r in lab.lab_issues(lines).collect())
    assert codes == ["ROW_LIMIT"] * 5 + ["UNSUPPORTED_CONTENT"]


def test_reconcile_readers(spark):
    rows = [("same", c, 1, "a ", "1", "mg", "r") for c in ("text_layer", "ocr", "vision")]
    rows += [("clash", c, 1, "a", "1" if c == "ocr" else "2", "mg" if c == "ocr" else "g", "r") for c in ("text_layer", "ocr", "vision")]
    rows += [("odd", "text_layer", 1, "a", "1", "mg", "r"), ("odd", "ocr", 1, "a", "1", "mg", "r"), ("odd", "ocr", 2, "b", "1", "mg", "r")]
    readers = spark.createDataFrame(rows, "document_id string, channel string, row int, test string, result string, unit string, reference string")
    origins = spark.createDataFrame([("same", "NATIVE"), ("clash", "NATIVE"), ("odd", "NATIVE")], "document_id string, text_layer_origin string")
    decisions, _ = lab.reconcile_readers(readers, origins)
    assert {r.document_id: (r.decision, r.issues) for r in decisions.collect()} == {
        "same": ("CONSISTENT_3", 0), "clash": ("REVIEW_CONFLICT", 2), "odd": ("REVIEW_ALIGNMENT", 1)}


# ---- statements --------------------------------------------------------------------------
def test_bind_and_duplicate(spark):
    block = "Пациент отрицает кашель. Принимает Метформин. Кашель сухой."
    rows = spark.createDataFrame([("d", 0, "p0:b0", "paragraph", 0, 0, len(block.encode()), block)],
                                 "document_id string, block_order int, block_id string, kind string, page_index int, start_byte int, end_byte int, text string")
    c = [("d", 0, "p0:b0", "метформин", "MEDICATION", "PATIENT", "UNKNOWN", "TAKING", "CURRENT", "Принимает Метформин."),
         ("d", 1, "p0:b0", "Метформин", "MEDICATION", "PATIENT", "UNKNOWN", "TAKING", "CURRENT", "Принимает Метформин."),
         ("d", 2, "p0:b0", "кашель", "SYMPTOM", "PATIENT", "NEGATED", "TAKING", "CURRENT", "Пациент отрицает кашель."),
         ("d", 3, "p9:b9", "x", "SYMPTOM", "PATIENT", "NEGATED", "NOT_APPLICABLE", "CURRENT", "x")]
    cands = spark.createDataFrame(c, "document_id string, ord int, block_id string, name string, kind string, subject string, assertion string, "
                                     "medication_state string, temporality string, source_text string")
    kept, issues = statements.bind_statements(cands, statements.plan_blocks(rows))
    got = kept.collect()
    assert [(r.name, block.encode()[r.start_byte:r.end_byte].decode()) for r in got] == [("Метформин", "Принимает Метформин.")]
    assert sorted((r.code, r.block_id or "") for r in issues.collect()) == [
        ("DUPLICATE", "p0:b0"), ("REJECTED_CANDIDATE", ""), ("REJECTED_CANDIDATE", "p0:b0")]


# ---- retrieval ---------------------------------------------------------------------------
def brute_bm25(docs, query):
    words = {k: re.findall(r"\w+", v.casefold()) or ["_"] for k, v in docs.items()}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = {}
    for w in words.values():
        for token in set(w):
            df[token] = df.get(token, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    score = {}
    for key, w in words.items():
        score[key] = round(sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl))
                               for t in re.findall(r"\w+", query.casefold())), 8)
    return sorted(score, key=lambda k: (-score[k], k))


def test_bm25_equals_brute_force_even_with_negative_idf(spark):
    rng = random.Random(11)
    for vocabulary in ("abcdefgh", "ab"):
        docs = {f"c{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for i in range(12)}
        queries = [(0, "a b b"), (1, "zzz"), (2, "c a")]
        frame = spark.createDataFrame([(k, k, v) for k, v in docs.items()], "chunk_id string, document_id string, text string")
        asked = spark.createDataFrame(queries, "question_id int, text string")
        got = retrieve.sparse_ranks(asked, frame, 6).orderBy("question_id", "sparse_rank").collect()
        for q, text in queries:
            assert [r.chunk_id for r in got if r.question_id == q] == brute_bm25(docs, text)[:6]


def test_dense_paths_agree(spark):
    rng = random.Random(13)
    vec = lambda: [float(rng.randint(0, 3)) for _ in range(4)]
    chunk_rows = [(f"c{i:02d}", rng.randint(0, 1), vec()) for i in range(40)]
    question_rows = [(i, rng.randint(0, 1), vec()) for i in range(5)]
    c = spark.createDataFrame(chunk_rows, "chunk_id string, scope int, embedding array<float>")
    q = spark.createDataFrame(question_rows, "question_id int, scope int, embedding array<float>")
    one = {(r.question_id, r.dense_rank): r.chunk_id for r in retrieve.dense_ranks(q, c, 7).collect()}
    two = {(r.question_id, r.dense_rank): r.chunk_id for r in retrieve.dense_ranks(q, c, 7, broadcast_bytes=0).collect()}

    def distance(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return round(1 - sum(x * y for x, y in zip(a, b)) / (na * nb), 8) if na and nb else 1.0

    want = {}
    for qid, scope, qv in question_rows:
        order = sorted((distance(qv, cv), cid) for cid, cs, cv in chunk_rows if cs == scope)[:7]
        want |= {(qid, i + 1): cid for i, (_, cid) in enumerate(order)}
    assert one == two == want


# ---- scoring -----------------------------------------------------------------------------
def test_greedy_pairs_equal_brute_force(spark):
    rng = random.Random(17)
    edges = [(rng.randint(0, 3), g, p, rng.randint(0, 2)) for g in range(8) for p in range(8) if rng.random() < 0.5]
    frame = spark.createDataFrame(edges, "grp int, gold_idx int, pred_idx int, score int")
    want = set()
    for group in range(4):
        used = set()
        for g in range(8):
            options = sorted((-s, p) for grp, gg, p, s in edges if grp == group and gg == g and p not in used)
            if options:
                used.add(options[0][1])
                want.add((group, g, options[0][1]))
    assert {tuple(r) for r in scoring.greedy_pairs(frame, ["grp"]).collect()} == want


def test_duplicate_prediction_is_fp(spark):
    gold = spark.createDataFrame([("d", "x")], "case string, v string")
    found = spark.createDataFrame([("d", "x"), ("d", "x")], "case string, v string")
    assert tuple(scoring.multiset_counts(gold, found, ["case"], ["v"]).first())[1:] == (1, 1, 0)


def test_family_promoted_to_patient_is_critical(spark):
    schema = ("case string, idx int, name string, kind string, subject string, assertion string, medication_state string, temporality string, "
              "source_text string, page int")
    gold = spark.createDataFrame([("d", 0, "Asthma", "CONDITION", "FAMILY", "CONFIRMED", "NOT_APPLICABLE", "CURRENT", "Mother has Asthma.", 1),
                                  ("e", 0, "Cold", "CONDITION", "PATIENT", "CONFIRMED", "NOT_APPLICABLE", "CURRENT", "Cold.", 1)], schema)
    found = spark.createDataFrame([("d", 0, "asthma", "CONDITION", "PATIENT", "CONFIRMED", "NOT_APPLICABLE", "CURRENT", "Mother has Asthma.", 1)], schema)
    parts = scoring.score_statements(gold, found)
    assert {r.case: (r.tp, r.fp, r.fn, r.critical) for r in parts["totals"].collect()} == {"d": (0, 1, 1, 1), "e": (0, 0, 1, 0)}
    classes = {(r.case, r.field, r.label): (r.tp, r.fp, r.fn) for r in parts["classes"].collect()}
    assert classes[("d", "subject", "FAMILY")] == (0, 0, 1) and classes[("d", "subject", "PATIENT")] == (0, 1, 0)


@pytest.mark.parametrize("few", [4, 65_536])
def test_percentiles_equal_brute_force(spark, few):
    rng = random.Random(19)
    values = [(g, float(rng.randint(0, 50)) ** 3) for g in "ab" for _ in range(rng.randint(1, 40))]
    frame = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in scoring.percentiles(frame, ["g"], "v", {"p50": 0.5, "p95": 0.95}, buckets=8, ordered=few).collect()}
    for g in "ab":
        ordered = sorted(v for k, v in values if k == g)
        assert got[g] == tuple(ordered[round(q * (len(ordered) - 1))] for q in (0.5, 0.95))


# ---- redaction ---------------------------------------------------------------------------
def packages(spark, *texts):
    return redact.redact(spark.createDataFrame([(i, [t], "") for i, t in enumerate(texts)],
                                               "package_id int, fields array<string>, identifier_context string"))


def test_people_and_units(spark):
    out = {r.package_id: (r.texts, r.code) for r in packages(
        spark, "Doctor: Irene Bell. A bell-shaped curve of 5 mm. Irene measured it.", "АД 120/80, 5 мг/кг/сут, 12/05/2024, mmol/L",
        "Иванов Иван Иванович. Пациент Иванов жалуется.", "MRN 777 and count 777 cells", "MRN: 12345-A seen. Later 12345-A again").collect()}
    assert out[0] == (["Doctor: [DOCTOR_A]. A bell-shaped curve of 5 mm. [DOCTOR_A] measured it."], None)
    assert out[1] == (["АД 120/80, 5 мг/кг/сут, 12/05/2024, mmol/L"], None)
    assert out[2] == (["[PERSON_A]. Пациент [PERSON_A] жалуется."], None)
    assert out[3] == (None, "CLINICAL_CONTENT_CHANGED")
    assert out[4] == (["[IDENTIFIER] seen. Later [IDENTIFIER] again"], None)


def test_missing_values_block(spark):
    rows = [(0, ["ok text", None], ""), (1, None, ""), (2, ["ok text"], None), (3, [], "")]
    frame = spark.createDataFrame(rows, "package_id int, fields array<string>, identifier_context string")
    out = {r.package_id: (r.texts, r.code) for r in redact.redact(frame).collect()}
    assert out == {0: (None, "PRIVACY_CHECK_FAILED"), 1: (None, "PRIVACY_CHECK_FAILED"), 2: (["ok text"], None), 3: ([], None)}
    long = {r.package_id: r.code for r in redact.redact(frame, max_chars=3).collect()}
    assert long[2] == "PRIVACY_CHECK_FAILED" and long[3] is None


def test_proposals_outside_the_form_block(spark):
    clean = packages(spark, "He met Orla today", "He met Orla today", "He met Orla today")
    spans = spark.createDataFrame([(0, 0, "Orla", "SECRET"), (1, 0, " ", "PERSON"), (2, 0, "Orla", "PERSON"), (2, 1, "met", "PERSON")],
                                  "package_id int, ord int, text string, category string")
    out = {r.package_id: (r.texts, r.code) for r in redact.apply_identifier_spans(clean, spans).collect()}
    assert out == {0: (None, "PRIVACY_CHECK_FAILED"), 1: (None, "PRIVACY_CHECK_FAILED"), 2: (["He [PERSON_B] [PERSON_A] today"], None)}
    assert {r.code for r in redact.apply_identifier_spans(clean, spans, max_spans=1).collect()} == {"PRIVACY_CHECK_FAILED"}


def test_span_inside_word(spark):
    clean = packages(spark, "Принимает Метформин утром")
    spans = spark.createDataFrame([(0, 0, "ин", "PERSON")], "package_id int, ord int, text string, category string")
    strict = redact.apply_identifier_spans(clean, spans, strict=True).first()
    loose = redact.apply_identifier_spans(clean, spans).first()
    assert strict.texts is None and strict.code == "PRIVACY_CHECK_FAILED"
    assert loose.texts == ["Принимает Метформин утром"] and loose.warnings == ["SPAN_NOT_REPLACEABLE"]


# ---- lifecycle ---------------------------------------------------------------------------
def test_duplicate_content_is_a_conflict(spark):
    rows = spark.createDataFrame([(1, "t", "NOTE", None, "abc", [" a ", "a"], None), (2, "t", "NOTE", None, "abc", None, None),
                                  (3, "t", "NOTE", None, "xyz", None, None)],
                                 "document_id int, title string, document_type string, document_date date, text string, tags array<string>, created_at timestamp")
    stored = spark.createDataFrame([(hashlib.sha256(b"xyz").hexdigest(), None)], "sha256 string, deleted_at timestamp")
    out = lifecycle.register_documents(rows, stored)
    assert [(r.document_id, r.tags) for r in out["documents"].collect()] == [(1, ["a"])]
    assert sorted(r.document_id for r in out["conflicts"].collect()) == [2, 3]
