"""Archive evidence, ranking inside periods, linear packing."""

import datetime
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliarc.operators import chunks, evidence, retrieve
from foliarc.session import durable
from tests.test_operators import brute_bm25

DAY = datetime.date
TODAY = "2026-09-24"
CHUNK = "chunk_id string, document_id string, revision_id string, position int, text string, source string, user_correction boolean, embedding array<float>"
QUOTE = "question_id int, retry int, batch int, ord int, number int, quote string"


def archive(spark, documents, questions):
    """Catalogue, one chunk for each document with a text, and questions (id, text, from, to)."""
    catalogue = spark.createDataFrame([(d, date, None) for d, date, _ in documents], "document_id string, document_date date, active_revision_id string")
    rows = [(f"c-{d}", d, None, 1, text, f"{d}.md", False, [1.0, 0.0]) for d, _, text in documents if text is not None]
    asked = spark.createDataFrame([(*q, [1.0, 0.5]) for q in questions], "question_id int, question string, date_from date, date_to date, embedding array<float>")
    return asked, catalogue, spark.createDataFrame(rows, CHUNK)


def test_dates_undated_and_missing_documents_are_visible(spark):
    documents = [("old", DAY(2024, 1, 1), "Some observation."), ("new", DAY(2026, 1, 1), "Some observation."),
                 ("missing", DAY(2026, 2, 1), None), ("undated", None, "Some observation.")]
    chosen = evidence.select_evidence(*archive(spark, documents, [(1, "overview", DAY(2025, 9, 24), None), (2, "overview", None, None)]), today=F.lit(TODAY).cast("date"))
    quotes = chosen["readings"].join(chosen["selected"], "reading").select(
        "question_id", F.lit(0).alias("retry"), "batch", F.col("number").alias("ord"), "number", F.lit("Some observation.").alias("quote"))
    out = evidence.archive_answers(chosen, quotes, spark.createDataFrame([], "question_id int, retry int, batch int"))
    first, second = out["answers"].orderBy("question_id").collect()
    assert (first.eligible_documents, first.missing_indexed, first.undated_documents, first.complete, len(first.warnings)) == (2, 1, 1, False, 3)
    assert (second.eligible_documents, second.scanned_chunks, second.scanned_documents) == (4, 3, 3)
    found = {q: [r.document_id for r in out["sources"].filter(F.col("question_id") == q).orderBy("citation").collect()] for q in (1, 2)}
    assert found == {1: ["new"], 2: ["old", "new", "undated"]}


def test_failing_batch_is_read_again_chunk_by_chunk(spark):
    documents = [(f"d{i:02d}", DAY(2026, 1, 1 + i), f"Observation number {i}.") for i in range(14)]
    chosen = evidence.select_evidence(*archive(spark, documents, [(1, "overview", None, None), (2, "overview", None, None)]), today=F.lit(TODAY).cast("date"))
    assert chosen["selected"].count() == 14 and chosen["left_out"].count() == 0  # both questions share one reading
    said = [(q, 0, b, i, n, "Invented." if b == 1 else f"Observation number {6 * b + n - 1}.") for q in (1, 2)
            for i, (b, n) in enumerate((b, n) for b in range(3) for n in range(1, 7) if 6 * b + n <= 14)]
    again = [(1, 1, b, 0, 1, f"Observation number {6 + b}." if b != 2 else "Invented again.") for b in range(6)]
    errors = spark.createDataFrame([(2, 1, b) for b in range(6)], "question_id int, retry int, batch int")
    answers = evidence.archive_answers(chosen, spark.createDataFrame(said + again, QUOTE), errors)["answers"].orderBy("question_id").collect()
    assert [r.failed_batches for r in answers] == [1, 6] and not any(r.complete for r in answers)
    assert [i for i in range(14) if f"number {i}." in answers[0].answer] == [i for i in range(14) if i != 8]
    assert [i for i in range(14) if f"number {i}." in answers[1].answer] == [0, 1, 2, 3, 4, 5, 12, 13]
    none = evidence.archive_answers(chosen, spark.createDataFrame([], QUOTE), spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "question_id int, retry int, batch int"))
    assert {r.question_id: r.reason for r in none["answers"].collect()} == {1: "EVIDENCE_VALIDATION_FAILED", 2: "NO_CONFIRMED_EVIDENCE"}


def test_limit_lists_what_it_leaves_out(spark):
    documents = [(f"d{i:02d}", None, f"Observation {i}." + " overview" * (i % 5)) for i in range(16)]
    chosen = evidence.select_evidence(*archive(spark, documents, [(1, "overview", None, None)]), limit=12, today=F.lit(TODAY).cast("date"))
    coverage = chosen["coverage"].first()
    assert (coverage.eligible_chunks, coverage.scanned_chunks, coverage.scanned_documents, coverage.complete) == (16, 12, 12, False)
    read, left = ({r.chunk_id for r in chosen[c].collect()} for c in ("selected", "left_out"))
    assert len(read) == 12 and len(left) == 4 and len(read | left) == 16
    assert {r.reason for r in chosen["left_out"].collect()} == {"BEYOND_SCAN_LIMIT"}


def test_periods_meet_each_document_once(spark):
    draw = random.Random(3)
    day = lambda: DAY(2020, 1, 1) + datetime.timedelta(days=draw.randint(0, 400))
    rows = [(i, None if i % 9 == 0 else DAY(2020, 6, 1) if i % 3 == 0 else day()) for i in range(120)]
    scopes = [("-/-", None, None), ("a", DAY(2020, 6, 1), DAY(2020, 6, 1)), ("b", DAY(2020, 5, 30), None), ("c", None, DAY(2020, 2, 1)),
              ("d", DAY(2021, 1, 1), DAY(2020, 1, 1)), *[(f"s{i}", *sorted((day(), day()))) for i in range(12)]]
    got = evidence.eligible_documents(spark.createDataFrame(scopes, "scope string, date_from date, date_to date"),
                                      spark.createDataFrame(rows, "document_id int, document_date date")).collect()
    want = [(s, i) for s, a, b in scopes for i, d in rows if (a is None and b is None) or (d and (a is None or d >= a) and (b is None or d <= b))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bm25_inside_periods_equals_a_corpus_of_the_period(spark):
    draw = random.Random(7)
    docs = {f"c{i:02d}": " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for i in range(40)}
    dates = {c: None if draw.random() < 0.2 else DAY(2020, 1, 1) + datetime.timedelta(days=draw.randint(0, 9)) for c in docs}
    frame = spark.createDataFrame([(c, t, dates[c]) for c, t in docs.items()], "chunk_id string, text string, document_date date")
    spans = [(None, None), (DAY(2020, 1, 3), DAY(2020, 1, 6)), (DAY(2020, 1, 5), None), (None, DAY(2020, 1, 2)), (DAY(2030, 1, 1), None)]
    asked = [(i, draw.choice(["a b b", "c zzz", "h g a"]), *span) for i, span in enumerate(spans * 2)]
    questions = spark.createDataFrame(asked, "question_id int, text string, date_from date, date_to date")
    counts = retrieve.word_counts(frame)
    for given in (None, counts):
        got = retrieve.sparse_ranks(questions, frame, 6, given).orderBy("question_id", "sparse_rank").collect()
        for i, text, low, high in asked:
            mine = {c: t for c, t in docs.items() if (low is None and high is None) or (dates[c] and (not low or dates[c] >= low) and (not high or dates[c] <= high))}
            assert [r.chunk_id for r in got if r.question_id == i] == (brute_bm25(mine, text)[:6] if mine else [])
    gone, new = frame.filter("chunk_id < 'c05'"), frame.filter("chunk_id > 'c30'")
    kept = retrieve.merge_counts(retrieve.word_counts(frame.filter("chunk_id <= 'c30'")), retrieve.word_counts(new), retrieve.word_counts(gone))
    want = retrieve.word_counts(frame.filter("chunk_id >= 'c05'"))
    assert sorted(map(str, kept.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_hundred_thousand_questions_fit_a_task():
    draw = np.random.default_rng(1)
    asked, words = 100_000, 20
    token = np.minimum(draw.zipf(1.2, asked * words), 50_000)
    table = pa.table({"scope": np.zeros(asked * words, np.int64), "question_id": np.repeat(np.arange(asked), words), "low": pa.nulls(asked * words, pa.int32()),
                      "high": pa.nulls(asked * words, pa.int32()), "token": [f"w{t}" for t in token], "qtf": np.ones(asked * words), "idf": 1 / token, "avgdl": np.full(asked * words, 30.0)})
    model = retrieve._sparse_models(table)[0]
    assert sum(v.nbytes for v in model.values() if hasattr(v, "nbytes")) < 64 * 1024 * 1024
    texts = [[f"w{t}" for t in np.minimum(draw.zipf(1.2, 30), 50_000)] for _ in range(30)]
    top = retrieve.TopLists(asked, 3)
    for at in range(0, 30, 10):
        top.add(retrieve._bm25_block(model, pa.array(texts[at:at + 10])), list(range(at, at + 10)))
    top.clear()
    question, score, at = top.parts[0]
    for q in (0, 4711, 99_999):
        mine = dict(zip(*np.unique(token[q * words:(q + 1) * words], return_counts=True)))
        want = [round(sum(n / t * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(text) / 30.0)) for t, n in mine.items() for f in [text.count(f"w{t}")] if f), 8) for text in texts]
        best = sorted(range(30), key=lambda i: (-want[i], i))[:3]
        assert [top.ids[i] for i in at[question == q]] == best and np.allclose(score[question == q], [want[i] for i in best], atol=2e-8)


def test_top_lists_keep_the_first_of_equal_scores(monkeypatch):
    monkeypatch.setattr(retrieve, "MATRIX_CELLS", 40)
    draw = np.random.default_rng(2)
    scores = draw.integers(0, 4, (90, 7)).astype(float)
    scores[draw.random(scores.shape) < 0.1] = -np.inf
    top = retrieve.TopLists(7, 5)
    for at in range(0, 90, 9):
        top.add(scores[at:at + 9], list(range(at, at + 9)))
    top.clear()
    for q in range(7):
        want = sorted((i for i in range(90) if scores[i, q] > -np.inf), key=lambda i: (-scores[i, q], i))[:5]
        assert [top.ids[i] for i in top.parts[0][2][top.parts[0][0] == q]] == want


def greedy_batches(sizes, max_items, max_size):
    out, batch, items, held = [], 0, 0, 0
    for size in sizes:
        if items and (items >= max_items or held + size > max_size):
            batch, items, held = batch + 1, 0, 0
        out.append(batch)
        items, held = items + 1, held + size
    return out


def test_batches_equal_a_walk_and_survive_splits():
    draw = random.Random(9)
    for _ in range(200):
        keys = [[draw.choice([0, 1, 5, 9, 30]) for _ in range(draw.randint(1, 20))] for _ in range(draw.randint(1, 4))]
        most, limit = draw.randint(1, 5), draw.choice([4, 12, 25])
        first = np.array([i == 0 for k in keys for i in range(len(k))])
        size = np.array([s for k in keys for s in k])
        cut, got, state = draw.randint(0, len(size)), [], (0, 0, 0)
        for some in (slice(0, cut), slice(cut, None)):
            if len(size[some]):
                numbers, state = chunks.batch_numbers(first[some], size[some], most, limit, state)
                got += numbers.tolist()
        assert got == [b for k in keys for b in greedy_batches(k, most, limit)]


def test_a_hot_key_is_packed_in_order(spark):
    rows = [(k if i % 3 else "hot", i, (i * 7) % 13) for i, k in enumerate("abcde" * 400)]
    got = chunks.pack_batches(spark.createDataFrame(rows, "k string, at int, n int"), ["k"], ["at"], F.col("n"), 4, 25).collect()
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in got if r.k == key)
        assert [r.batch for r in sorted(mine, key=lambda r: r.at)] == greedy_batches([r.n for r in sorted(mine, key=lambda r: r.at)], 4, 25)


def folded_cuts(spans, size, overlap):
    """Chunks by the fold of the definition: units one by one, whole trailing units repeated."""
    out, current = [], []
    for unit in spans:
        if current and unit[1] - current[0][0] > size:
            out.append((current[0][0], current[-1][1]))
            current = [u for u in current if current[-1][1] - u[0] <= overlap and unit[1] - u[0] <= size]
        current.append(unit)
    return out + ([(current[0][0], current[-1][1])] if current else [])


def test_cut_points_equal_the_fold():
    draw = random.Random(10)
    for _ in range(400):
        kept = np.array([draw.choice([0, 1, 4, 9, 14]) for _ in range(draw.randint(0, 25))], np.int64)
        lead = np.array([draw.randint(0, 2) for _ in kept], np.int64)
        length = kept + lead + np.array([draw.randint(0, 2) for _ in kept], np.int64)
        begin = np.cumsum(length) - length + lead
        spans = [(int(b), int(b + k)) for b, k in zip(begin, kept) if k]
        size = draw.choice([14, 20, 33])
        overlap = draw.randint(0, size - 1)
        got = chunks.cut_points(lead, kept, length, size, overlap).reshape(-1, 2)
        assert [(int(begin[a]), int(begin[b] + kept[b])) for a, b in got] == folded_cuts(spans, size, overlap)


def test_twenty_megabytes_split_in_linear_time(spark):
    text = "".join(f"Sentence number {i} of a long report. " for i in range(520_000))
    assert len(text) > 20_000_000
    got = chunks.split_chunks(spark.createDataFrame([(text,)], "t string"), "t", "c").select(F.explode("c").alias("c"))
    row = got.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("c")).alias("most"), F.min(F.length("c")).alias("least")).first()
    assert row.most <= 900 and row.n > 20_000 and math.isclose(row.n, len(text) / 790, rel_tol=0.2)
    first = got.limit(2).collect()
    assert text.startswith(first[0].c) and re.search(r"Sentence number \d+ of a long report\.$", first[0].c) and first[1].c in text


def test_equal_quotes_of_a_chunk_are_verified_once(spark):
    documents = [(f"d{d}", DAY(2025, 9, d), f"text of day {d}") for d in (1, 2)]
    chosen = evidence.select_evidence(*archive(spark, documents, [(n, "overview", None, None) for n in range(1, 6)]), today=F.lit(TODAY).cast("date"))
    text = chosen["chunks"].orderBy("chunk_id").first()["text"]
    rows = chosen["selected"].select("reading", "batch", "number", "chunk_id").orderBy("chunk_id").first()
    said = [(n, 0, rows["batch"], 1, rows["number"], text if n < 5 else "invented words") for n in range(1, 6)]
    quotes = spark.createDataFrame(said, QUOTE).join(chosen["readings"], "question_id").drop("retry")
    bound, checked = evidence._verify_quotes(quotes, chosen["selected"], chosen["chunks"])
    assert bound.count() == 5 and bound.filter("excerpt_digest IS NULL").count() == 1
    assert sorted(r["excerpt"] is None for r in checked.collect()) == [False, True]


def test_durable_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kept = durable(spark.range(100).mapInPandas(counting, "id long"))
    assert kept.count() == 100 and seen.value == 100


def test_answers_are_put_together_from_sorted_pieces(spark):
    """No aggregate gathers paragraphs: a question's text passes in batches, and its digest holds none of it."""
    documents = [(f"d{i:03d}", DAY(2026, 1, 1) + datetime.timedelta(days=i), f"Наблюдение {i}. " + "é" * (1 + i % 7)) for i in range(60)]
    asked = [(n, "overview", DAY(2026, 1, 20) if n == 3 else None, None) for n in range(1, 5)]
    chosen = evidence.select_evidence(*archive(spark, documents, asked), today=F.lit(TODAY).cast("date"))
    pairs = chosen["readings"].join(chosen["selected"], "reading").join(chosen["chunks"].select("chunk_id", "text"), "chunk_id")
    quotes = pairs.filter("question_id < 4").select("question_id", F.lit(0).alias("retry"), "batch", F.col("number").alias("ord"), "number", F.col("text").alias("quote"))
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = evidence.archive_answers(chosen, quotes, spark.createDataFrame([], "question_id int, retry int, batch int"))
        answers = {r.question_id: r for r in out["answers"].collect()}
        digests = {r.question_id: r.answer_md5 for r in evidence.answer_digests(out["paragraphs"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    for n in (1, 2, 3):
        mine = [d for d in documents if n != 3 or d[1] >= DAY(2026, 1, 20)]
        want = "По записям архива (даты документов):\n\n" + "\n\n".join(f"{day}: {text.strip()} [{i}]" for i, (_, day, text) in enumerate(mine, 1))
        assert answers[n].answer == want and digests[n] == hashlib.md5(want.encode()).hexdigest()
    assert set(digests) == {1, 2, 3} and answers[4].reason == "NO_CONFIRMED_EVIDENCE" and answers[4].insufficient
    plan = evidence.answer_digests(out["paragraphs"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
