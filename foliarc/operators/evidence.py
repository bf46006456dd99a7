"""Graded retrieval, quote-verified answers, archive evidence scans and public packages.

Model output (grades, quotes, identifier spans) arrives as tables; every proposal is checked
against the chunk it cites before it can appear in an answer.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.numbers import resolve_period
from foliarc.functions.text import complete_excerpt, non_blank, strip, verified_excerpt
from foliarc.operators.chunks import pack_batches
from foliarc.operators.redact import apply_identifier_spans, redact
from foliarc.operators.retrieve import ranked_chunks, visible_chunks
from foliarc.session import by_key, durable, fits_broadcast


# ---- corrective retrieval ----------------------------------------------------------------
def grade_and_route(retrieved: DataFrame, grades: DataFrame, chunks: DataFrame,
                    min_relevant: int = vocab.MIN_RELEVANT_CHUNKS,
                    retries: int = vocab.CORRECTIVE_RETRIES,
                    questions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(routes, relevant). With ``questions`` (question_id), one for which nothing was retrieved gets its
    route too: insufficient after the last retry.

    ``retrieved``: question_id, pass (0..retries), rank, chunk_id; ``grades``: question_id, pass,
    chunk_id, relevant, evidence. A grade counts only when its evidence verifies in the chunk. The
    first pass with enough relevant chunks is used, else the last one.
    """
    judged = retrieved.join(grades, ["question_id", "pass", "chunk_id"], "left").join(
        chunks.select("chunk_id", "text"), "chunk_id", "left")
    accepted = (F.coalesce("relevant", F.lit(False)) & F.coalesce(non_blank(F.col("evidence")), F.lit(False))
                & verified_excerpt(F.col("evidence"), F.col("text")).isNotNull())
    judged = judged.filter(F.col("pass") <= retries).withColumn("accepted", accepted)
    passes = judged.groupBy("question_id", "pass").agg(F.count_if("accepted").alias("found"))
    enough = F.col("found") >= min_relevant
    routes = passes.groupBy("question_id").agg(
        F.coalesce(F.min(F.when(enough, F.col("pass"))), F.max("pass")).alias("pass"),
        F.bool_or(enough).alias("sufficient")).withColumn("retry_count", F.col("pass"))
    if questions is not None:
        routes = questions.select("question_id").distinct().join(routes, "question_id", "left").select(
            "question_id", F.coalesce("pass", F.lit(retries)).cast(routes.schema["pass"].dataType).alias("pass"),
            F.coalesce("sufficient", F.lit(False)).alias("sufficient"),
            F.coalesce("retry_count", F.lit(retries)).cast(routes.schema["retry_count"].dataType).alias("retry_count"))
    kept = judged.filter("accepted").join(routes.filter("sufficient").select("question_id", "pass"), ["question_id", "pass"])
    order = W.partitionBy("question_id").orderBy("rank")
    relevant = kept.withColumn("citation", F.row_number().over(order)).select("question_id", "citation", "chunk_id")
    return routes, relevant


def introduction(question: Column) -> Column:
    return F.when(question.rlike("[А-Яа-яЁё]"), F.lit(vocab.INTRO_RU)).otherwise(F.lit(vocab.INTRO_EN))


def assemble_answers(questions: DataFrame, relevant: DataFrame, attempts: DataFrame, quotes: DataFrame,
                     chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, parts).

    ``attempts``: question_id, attempt, insufficient, error; ``quotes``: question_id, attempt, ord,
    citation, quote. One bad citation or quote drops the whole attempt; the first attempt that
    abstains or verifies decides.
    """
    bound = quotes.join(relevant, ["question_id", "citation"], "left").join(
        chunks.select("chunk_id", "text"), "chunk_id", "left").withColumn(
        "excerpt", verified_excerpt(F.col("quote"), F.col("text")))
    checked = bound.groupBy("question_id", "attempt").agg(F.bool_and(F.col("excerpt").isNotNull()).alias("valid"))
    able = relevant.select("question_id").distinct().withColumn("_able", F.lit(True))
    state = attempts.join(checked, ["question_id", "attempt"], "left").filter(F.col("error").isNull())
    decisive = state.filter(F.col("insufficient") | F.coalesce("valid", F.lit(False)))
    chosen = decisive.groupBy("question_id").agg(
        F.min("attempt").alias("attempt"), F.min_by("insufficient", "attempt").alias("abstains")).filter(~F.col("abstains"))
    used = bound.join(chosen.join(able, "question_id").select("question_id", "attempt"), ["question_id", "attempt"])
    parts = used.groupBy("question_id", "citation", "excerpt", "chunk_id").agg(F.min("ord").alias("ord"))
    texts = parts.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "citation", "excerpt"))).alias("parts"))
    answered = questions.join(texts, "question_id", "left")
    body = F.array_join(F.transform("parts", lambda p: F.concat(
        p["excerpt"], F.lit(" ["), p["citation"].cast("string"), F.lit("]"))), "\n\n")
    answers = answered.select(
        "question_id", F.when(F.col("parts").isNotNull(), F.concat(introduction(F.col("question")), F.lit("\n\n"), body))
        .otherwise(F.lit(vocab.ABSTAIN)).alias("answer"), F.col("parts").isNull().alias("insufficient"),
        F.array_distinct(F.transform("parts", lambda p: p["citation"])).alias("citations"))
    return answers, parts.select("question_id", "ord", "citation", F.col("excerpt").alias("text"), "chunk_id")


# ---- archive scan ------------------------------------------------------------------------
def question_periods(questions: DataFrame, today: Column) -> DataFrame:
    """Questions with date_from, date_to, violation and the scope shared by equal periods."""
    resolved = questions.withColumn("_p", resolve_period(F.col("question"), F.col("date_from"), F.col("date_to"), today))
    return resolved.withColumn("date_from", F.col("_p.date_from")).withColumn("date_to", F.col("_p.date_to")).withColumn(
        "violation", F.col("_p.violation")).drop("_p").withColumn(
        "scope", F.concat_ws("/", F.coalesce(F.col("date_from").cast("string"), F.lit("-")),
                             F.coalesce(F.col("date_to").cast("string"), F.lit("-"))))


def dyadic_cells(low: Column, high: Column) -> Column:
    """Array of (level, cell): the disjoint blocks of 2^level days that make up [low, high]; empty if low > high."""

    @F.pandas_udf("array<struct<level:int,cell:long>>")
    def run(lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for first, last in zip(lows.astype(int), highs.astype(int)):
            level, cells = 0, []
            while first <= last:
                if first & 1:
                    cells.append({"level": level, "cell": first})
                    first += 1
                if first <= last and not last & 1:
                    cells.append({"level": level, "cell": last})
                    last -= 1
                first, last, level = first >> 1, last >> 1, level + 1
            out.append(cells)
        return pd.Series(out, dtype=object)

    return run(low, high)


def inside_periods(scopes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with document_date) once for each scope (scope, date_from, date_to, distinct) whose period holds them.

    A scope without a period holds every row. Other periods are cut into blocks of 2^level days; a row has
    one block on each level in use, so a pair meets exactly once and no year or day gathers all rows.
    """
    day = F.unix_date("document_date")
    every = scopes.filter(F.col("date_from").isNull() & F.col("date_to").isNull()).select("scope", F.lit(1).alias("__one")).distinct()
    whole = rows.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one").drop("__one")  # one row at most: scopes are distinct
    dated = rows.filter(F.col("document_date").isNotNull())
    reach = dated.agg(F.min(day), F.max(day)).first()
    bounded = scopes.filter(F.col("date_from").isNotNull() | F.col("date_to").isNotNull()).select("scope", "date_from", "date_to").distinct()
    if reach[0] is None:
        return whole.select("scope", *rows.columns)
    low = F.greatest(F.coalesce(F.unix_date("date_from"), F.lit(reach[0])), F.lit(reach[0]))
    high = F.least(F.coalesce(F.unix_date("date_to"), F.lit(reach[1])), F.lit(reach[1]))
    cells = durable(bounded.select("scope", F.explode(dyadic_cells(low, high)).alias("c")).select("scope", "c.level", "c.cell"))
    levels = [r["level"] for r in cells.select("level").distinct().orderBy("level").collect()]  # 22 at most
    if not levels:
        return whole.select("scope", *rows.columns)
    placed = dated.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn(
        "cell", F.expr(f"shiftright(cast(unix_date(document_date) as bigint), level)"))
    matched = placed.join(F.broadcast(cells) if fits_broadcast(cells, 64) else cells, ["level", "cell"])
    return whole.select("scope", *rows.columns).unionByName(matched.select("scope", *rows.columns))


def eligible_documents(scopes: DataFrame, documents: DataFrame) -> DataFrame:
    """scope, document_id for every document inside the scope's period."""
    return inside_periods(scopes, documents.select("document_id", "document_date")).select("scope", "document_id")


def diversify(ranked: DataFrame, limit: int) -> DataFrame:
    """Best chunk of every document ahead of the rest, rank order kept; at most ``limit`` per question."""
    first = W.partitionBy("question_id", "document_id").orderBy("rank")
    place = W.partitionBy("question_id").orderBy(F.col("_n") > 1, "rank")
    return ranked.withColumn("_n", F.row_number().over(first)).withColumn(
        "place", F.row_number().over(place)).filter(F.col("place") <= limit).drop("_n")


def _readable(catalogue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of active revisions with their document's date."""
    return visible_chunks(chunks, catalogue, keep=("document_date",))


def archive_coverage(questions: DataFrame, catalogue: DataFrame, chunks: DataFrame, limit: int | None = None,
                     today: Column | None = None) -> DataFrame:
    """What each valid question can read: counted from sums by day, without ranking anything.

    question_id, question, scope, date_from, date_to, eligible_documents, missing_indexed, eligible_chunks,
    scanned_chunks, undated, complete. With ``limit`` at most so many chunks are scanned. A row for each day
    of the calendar in use comes to the driver.
    """
    periods = question_periods(questions, today if today is not None else F.current_date())
    return _covered(periods.filter(F.col("violation").isNull()), catalogue, _readable(catalogue, chunks), limit)


def _covered(valid: DataFrame, catalogue: DataFrame, indexed: DataFrame, limit: int | None) -> DataFrame:
    have = indexed.groupBy("document_id").agg(F.count(F.lit(1)).alias("_chunks"))
    daily = catalogue.select("document_id", F.unix_date("document_date").alias("day")).join(have, "document_id", "left").groupBy("day").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_chunks").isNull()).alias("missing"), F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunks"))
    frame = daily.toPandas()
    dated = frame.dropna(subset=["day"]).sort_values("day")
    counts = ["documents", "missing", "chunks"]
    days, sums = dated["day"].to_numpy(np.int64), np.vstack([np.zeros(3, np.int64), dated[counts].to_numpy(np.int64).cumsum(axis=0)])
    whole = frame[counts].to_numpy(np.int64).sum(axis=0)
    undated = int(frame.loc[frame["day"].isna(), "documents"].sum())

    @F.pandas_udf("documents long, missing long, chunks long")
    def counted(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        first, last = low.fillna(-np.inf).to_numpy(float), high.fillna(np.inf).to_numpy(float)
        inside = sums[np.searchsorted(days, last, "right")] - sums[np.searchsorted(days, first, "left")]
        inside = np.maximum(inside, 0)
        inside[(low.isna() & high.isna()).to_numpy()] = whole
        return pd.DataFrame(inside, columns=counts)

    rows = valid.select("question_id", "question", "scope", "date_from", "date_to",
                        counted(F.unix_date("date_from").cast("double"), F.unix_date("date_to").cast("double")).alias("c"))
    scanned = F.col("c.chunks") if limit is None else F.least(F.lit(limit).cast("bigint"), F.col("c.chunks"))
    return rows.select("question_id", "question", "scope", "date_from", "date_to", F.col("c.documents").alias("eligible_documents"),
                       F.col("c.missing").alias("missing_indexed"), F.col("c.chunks").alias("eligible_chunks"), scanned.alias("scanned_chunks"),
                       F.lit(undated).cast("bigint").alias("undated"),
                       ((scanned == F.col("c.chunks")) & (F.col("c.missing") == 0)).alias("complete"))


PLACED = ["reading", "batch", "number", "chunk_id", "_date", "document_id", "position"]


def _packed(rows: DataFrame) -> DataFrame:
    """Batches of the chunks of each reading (reading, chunk_id, _date, document_id, position, size)."""
    order = ["_date", "document_id", "position", "chunk_id"]
    packed = pack_batches(rows, ["reading"], order, F.col("size"), vocab.ARCHIVE_BATCH_CHUNKS, vocab.ARCHIVE_BATCH_CHARS)
    place = F.row_number().over(W.partitionBy("reading", "batch").orderBy(*order))
    return durable(packed.withColumn("number", place).select(*PLACED))


def select_evidence(questions: DataFrame, catalogue: DataFrame, chunks: DataFrame, limit: int | None = None,
                    today: Column | None = None) -> dict[str, DataFrame]:
    """What archive questions read: periods, coverage, readings, selected, chunks and left_out.

    ``questions``: question_id, question, date_from, date_to, embedding; ``catalogue``: document_id,
    document_date, active_revision_id; ``chunks``: chunk_id, document_id, revision_id, position, text,
    source, user_correction, embedding.

    Without ``limit`` every eligible chunk is read. Questions with the same period read the same batches, so
    ``selected`` holds a period's chunks once (keys, no texts) and ``readings`` tells which reading a
    question has. With a limit the best chunks of each question are read, those of different documents
    first; ``left_out`` lists the others with the reason.
    """
    periods = question_periods(questions, today if today is not None else F.current_date())
    valid = periods.filter(F.col("violation").isNull())
    indexed = _readable(catalogue, chunks)
    scopes = valid.select("scope", "date_from", "date_to").distinct()
    date = F.coalesce(F.col("document_date").cast("string"), F.lit("9999")).alias("_date")
    keys = indexed.select("chunk_id", "document_id", "document_date", "position", F.length("text").cast("bigint").alias("size"))
    if limit is None:
        readings = valid.select("question_id", F.col("scope").alias("reading"))
        rows = inside_periods(scopes, keys).select(F.col("scope").alias("reading"), "chunk_id", date, "document_id", "position", "size")
        left_out = readings.select("question_id").limit(0).withColumn("chunk_id", F.lit(None).cast(indexed.schema["chunk_id"].dataType))
    else:
        readings = valid.select("question_id", F.col("question_id").cast("string").alias("reading"))
        ranked = ranked_chunks(
            valid.select("question_id", F.col("question").alias("text"), "date_from", "date_to", "embedding"),
            indexed.select("chunk_id", "document_date", "text", "embedding"), 2 * limit)
        best = diversify(ranked.select("question_id", "chunk_id", "rank").join(keys, "chunk_id"), limit)
        rows = best.select(F.col("question_id").cast("string").alias("reading"), "chunk_id", date, "document_id", "position", "size")
    selected = _packed(rows)
    coverage = _covered(valid, catalogue, indexed, limit)
    documents = selected.groupBy("reading").agg(F.countDistinct("document_id").alias("scanned_documents"))
    coverage = coverage.join(readings.join(documents, "reading", "left").select("question_id", "scanned_documents"), "question_id", "left").na.fill(
        0, ["scanned_documents"])
    if limit is not None:
        asked = valid.select("question_id", "scope", F.col("question_id").cast("string").alias("reading"))
        all_rows = inside_periods(scopes, keys.select("chunk_id", "document_date")).join(asked, "scope")
        left_out = all_rows.join(selected.select("reading", "chunk_id"), ["reading", "chunk_id"], "left_anti").select("question_id", "chunk_id")
    texts = indexed.select("chunk_id", "text", "source", "user_correction")
    return {"periods": periods, "coverage": coverage, "readings": readings, "selected": selected, "chunks": texts,
            "left_out": left_out.withColumn("reason", F.lit("BEYOND_SCAN_LIMIT"))}


def _verify_quotes(quotes: DataFrame, batches: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bound, checked) of one reading: quotes with their chunk and ``digest`` instead of words, and what each proved.

    ``checked``: chunk_id, digest, excerpt, excerpt_digest, source, user_correction. Questions that share a reading quote the same
    chunks, so equal quotes of a chunk are verified once and only digests are carried per question.
    """
    placed = quotes.join(batches, ["reading", "batch", "number"], "left")
    words = placed.select("chunk_id", "quote").filter("chunk_id IS NOT NULL AND quote IS NOT NULL").distinct()
    proved = by_key(words, "chunk_id").join(texts, "chunk_id").select(
        "chunk_id", _digest("quote").alias("digest"), complete_excerpt(F.col("quote"), F.col("text")).alias("excerpt"),
        "source", "user_correction")
    checked = durable(proved.withColumn("excerpt_digest", _digest("excerpt")), "excerpts")
    facts = checked.drop("excerpt")
    bound = placed.withColumn("digest", _digest("quote")).drop("quote").join(facts, ["chunk_id", "digest"], "left")
    return durable(bound, "quotes"), checked


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _verify_round(quotes: DataFrame, errors: DataFrame, batches: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, failed, checked) of one reading: one quote that does not verify, or an error, fails its batch.

    ``quotes``: question_id, reading, batch, ord, number, quote; ``errors``: question_id, reading, batch. Only the
    texts of quoted chunks are looked up.
    """
    known = batches.select("reading", "batch").distinct()
    bound, checked = _verify_quotes(quotes.join(known, ["reading", "batch"], "left_semi"), batches, texts)
    bad = bound.groupBy("question_id", "reading", "batch").agg(F.bool_or(F.col("excerpt_digest").isNull()).alias("bad")).filter("bad").select(
        "question_id", "reading", "batch").unionByName(
        errors.select("question_id", "reading", "batch").join(known, ["reading", "batch"], "left_semi")).distinct()
    return bound.join(bad, ["question_id", "reading", "batch"], "left_anti"), bad, checked


def retry_batches(selection: dict[str, DataFrame], failed: DataFrame) -> DataFrame:
    """The chunks of failed batches (question_id, reading, batch), each a batch of its own, numbered by question."""
    again = selection["selected"].join(failed.select("question_id", "reading", "batch"), ["reading", "batch"])
    place = F.row_number().over(W.partitionBy("question_id").orderBy("batch", "number")) - 1
    return again.withColumn("_again", place).select(
        "question_id", F.col("question_id").cast("string").alias("reading"), F.col("_again").alias("batch"), F.lit(1).alias("number"),
        "chunk_id", "_date", "document_id", "position")


def archive_answers(selection: dict[str, DataFrame], quotes: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """answers and sources of an archive scan; verdicts are answers without their text, paragraphs the pieces of it.

    An answer cites a part of the archive and grows with it: who needs only its digest or its pieces reads
    ``paragraphs`` (question_id, place, paragraph), see ``answer_digests``.

    ``quotes``: question_id, retry, batch, ord, number, quote; ``errors``: question_id, retry, batch of
    unreadable model output. A failed batch is read once more chunk by chunk (retry 1), see ``retry_batches``.
    """
    readings, texts = selection["readings"], selection["chunks"]
    read = lambda frame, n: frame.filter(F.col("retry") == n).drop("retry")
    own = lambda frame: frame.withColumn("reading", F.col("question_id").cast("string"))
    first, failed, proved = _verify_round(read(quotes, 0).join(readings, "question_id"), read(errors, 0).join(readings, "question_id"),
                                          selection["selected"], texts)
    # The retry is numbered by question and both rounds need the outcome: keep it.
    failed = durable(failed)
    again = durable(retry_batches(selection, failed).drop("question_id"))
    second, lost, proved_again = _verify_round(own(read(quotes, 1)), own(read(errors, 1)), again, texts)
    evidence = first.withColumn("retry", F.lit(0)).unionByName(second.withColumn("retry", F.lit(1)))
    excerpts = proved.unionByName(proved_again).filter("excerpt IS NOT NULL").groupBy(F.col("excerpt_digest").alias("excerpt")).agg(
        F.first("excerpt").alias("words"))
    correction = F.coalesce("user_correction", F.lit(False))
    when = F.struct("retry", "batch", "ord")
    entries = evidence.groupBy("question_id", "document_id", F.col("excerpt_digest").alias("excerpt"), correction.alias("corrected")).agg(
        F.min(when).alias("seen"), F.min_by(F.struct("chunk_id", "_date", "position", "source"), when).alias("c")).select(
        "question_id", "document_id", "excerpt", "corrected", "seen", "c.*")
    order = W.partitionBy("question_id").orderBy("_date", "document_id", "position", "seen")
    placed = durable(entries.withColumn("place", F.row_number().over(order)), "entries")
    firsts = placed.groupBy("question_id", "chunk_id").agg(F.min("place").alias("first_place"),
                                                          F.min_by(F.struct("document_id", "_date", "source", "position"), "place").alias("s"))
    numbers = firsts.withColumn("citation", F.row_number().over(W.partitionBy("question_id").orderBy("first_place")))
    cited = placed.join(numbers.select("question_id", "chunk_id", "citation"), ["question_id", "chunk_id"]).join(excerpts, "excerpt")
    date = F.when(F.col("_date") == "9999", F.lit(vocab.NO_DATE)).otherwise(F.col("_date"))
    paragraphs = cited.select("question_id", "place", F.concat(
        date, F.when(F.col("corrected"), F.lit(vocab.CORRECTION_NOTE)).otherwise(F.lit("")), F.lit(": "),
        F.col("words"), F.lit(" ["), F.col("citation").cast("string"), F.lit("]")).alias("paragraph"))
    found = placed.groupBy("question_id").agg(F.lit(True).alias("found"))
    failures = lost.groupBy("question_id").agg(F.count(F.lit(1)).alias("failed_batches"))
    joined = selection["coverage"].join(found, "question_id", "left").join(failures, "question_id", "left").na.fill(
        0, ["failed_batches"])
    joined = joined.withColumn("complete", F.col("complete") & (F.col("failed_batches") == 0))
    reason = (F.when(F.col("found"), F.lit("EVIDENCE_FOUND"))
              .when(F.col("failed_batches") > 0, F.lit("EVIDENCE_VALIDATION_FAILED"))
              .when(F.col("eligible_documents") == 0, F.lit("NO_DOCUMENTS_IN_PERIOD")).otherwise(F.lit("NO_CONFIRMED_EVIDENCE")))
    fixed = F.create_map(*[F.lit(v) for pair in vocab.REASON_TEXT.items() for v in pair])
    verdicts = joined.withColumn("reason", reason).select(
        "question_id", "reason", F.col("found").isNull().alias("insufficient"),
        "eligible_documents", "scanned_documents", "eligible_chunks", "scanned_chunks",
        F.col("undated").alias("undated_documents"), "missing_indexed", "failed_batches", "complete",
        F.array_compact(F.array(
            F.when(~F.col("complete"), F.lit(vocab.WARN_PARTIAL)), F.when(F.col("missing_indexed") > 0, F.lit(vocab.WARN_MISSING)),
            F.when((F.col("undated") > 0) & (F.col("date_from").isNotNull() | F.col("date_to").isNotNull()),
                   F.lit(vocab.WARN_UNDATED)))).alias("warnings"))
    whole = verdicts.join(_folded(paragraphs, "answer", _whole), "question_id", "left").withColumn(
        "answer", F.coalesce("answer", F.try_element_at(fixed, F.col("reason"))))
    answers = whole.select("question_id", "reason", "insufficient", "answer", *verdicts.columns[3:])
    sources = numbers.select("question_id", "citation", "chunk_id", F.col("s.document_id").alias("document_id"),
                             F.col("s.source").alias("source"), F.nullif(F.col("s._date"), F.lit("9999")).alias("document_date"))
    return {"answers": answers, "sources": sources, "verdicts": verdicts, "paragraphs": paragraphs}


def _whole() -> tuple[Callable, Callable]:
    held = io.BytesIO()
    return held.write, lambda: held.getvalue().decode()


def _digest_of_pieces() -> tuple[Callable, Callable]:
    digest = hashlib.md5()
    return digest.update, digest.hexdigest


def _folded(paragraphs: DataFrame, name: str, begin: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """question_id and ``name``: what ``begin``'s pair (add, result) makes of a question's answer, given piece by piece.

    Spark sorts the paragraphs; a task holds a batch of them and what ``add`` keeps of one question.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([result()])], names=["question_id", name])

        now = add = result = kind = None
        for batch in batches:
            kind = batch["question_id"].type
            for question, words in zip(batch["question_id"].to_pylist(), batch["paragraph"]):
                if add is None or question != now:
                    if add is not None:
                        yield out()
                    now, (add, result) = question, begin()
                    add(vocab.ARCHIVE_INTRO.encode())
                add(b"\n\n")
                add(words.as_buffer())
        if add is not None:
            yield out()

    rows = by_key(paragraphs, "question_id").sortWithinPartitions("question_id", "place").select("question_id", "paragraph")
    return rows.mapInArrow(run, f"question_id {rows.schema['question_id'].dataType.simpleString()}, {name} string")


def answer_digests(paragraphs: DataFrame) -> DataFrame:
    """question_id, answer_md5 of the answers that cite evidence, without putting one together."""
    return _folded(paragraphs, "answer_md5", _digest_of_pieces)


# ---- public boundary ---------------------------------------------------------------------
def public_packages(responses: DataFrame, spans: DataFrame, model_warnings: DataFrame | None = None,
                    max_parts: int | None = None, max_sources: int | None = None) -> DataFrame:
    """response_id, answer, sources, code, warnings: aliased and redacted answers.

    ``responses``: response_id, answer, insufficient, parts (array of citation, text), sources (array of
    citation, text); ``spans``: package_id, ord, text, category.
    """
    numbers = F.transform("sources", lambda s: s["citation"])
    unique = (F.size(F.array_distinct(numbers)) == F.size("sources")) & F.forall("sources", lambda s: s["citation"] >= 1)

    def source_text(citation: Column) -> Column:
        return F.get(F.filter("sources", lambda s: s["citation"] == citation), F.lit(0))["text"]

    few = (F.lit(True) if max_parts is None else F.size("parts") <= max_parts) & (
        F.lit(True) if max_sources is None else F.size("sources") <= max_sources)
    parts_ok = (F.size("parts") >= 1) & F.forall("parts", lambda p: F.coalesce(
        verified_excerpt(p["text"], source_text(p["citation"])) == strip(p["text"]), F.lit(False)))
    empty_ok = (F.size("sources") == 0) & (F.size("parts") == 0)
    valid = few & F.when(F.col("insufficient"), empty_ok).otherwise(unique & parts_ok)
    texts = F.transform("sources", lambda s: s["text"])
    fields = F.when(F.col("insufficient"), F.array(F.lit(vocab.ABSTAIN))).otherwise(
        F.concat(F.transform("parts", lambda p: p["text"]), texts))
    marked = durable(responses.withColumn("_valid", F.coalesce(valid, F.lit(False))))
    packages = marked.filter("_valid").select(F.col("response_id").alias("package_id"), fields.alias("fields"),
                                              F.array_join(texts, "\n").alias("identifier_context"))
    checked = apply_identifier_spans(redact(packages), spans, strict=True, model_warnings=model_warnings)
    joined = marked.join(checked.withColumnRenamed("package_id", "response_id"), "response_id", "left")
    count = F.when(F.col("insufficient"), F.lit(1)).otherwise(F.size("parts"))
    alias = F.transform("parts", lambda p: F.concat(
        F.lit("S"), F.array_position(numbers, p["citation"]).cast("string")))
    intro = F.when(F.startswith("answer", F.lit(vocab.INTRO_RU)), F.lit(vocab.INTRO_RU)).otherwise(F.lit(vocab.INTRO_EN))
    body = F.array_join(F.zip_with(F.slice("texts", F.lit(1), count), alias, lambda text, s: F.concat(
        text, F.lit(" ["), s, F.lit("]"))), "\n\n")
    code = F.when(~F.col("_valid"), F.lit("PRIVACY_CHECK_FAILED")).otherwise(F.col("code"))
    shown = F.transform(F.slice("texts", count + 1, F.greatest(F.size("sources"), F.lit(0))), lambda text, i: F.struct(
        F.concat(F.lit("S"), (i + 1).cast("string")).alias("reference"), text.alias("text")))
    return joined.withColumn("_code", code).select(
        "response_id",
        F.when(F.col("_code").isNull(), F.when(F.col("insufficient"), F.get("texts", F.lit(0))).otherwise(
            F.concat(intro, F.lit("\n\n"), body))).alias("answer"),
        F.when(F.col("_code").isNull(), shown).alias("sources"), F.col("_code").alias("code"), "warnings")


def public_references(responses: DataFrame) -> DataFrame:
    """response_id, reference (S1..Sn) and the local source behind it; never leaves the archive."""
    rows = responses.select("response_id", F.posexplode("sources").alias("at", "source"))
    return rows.select("response_id", F.concat(F.lit("S"), (F.col("at") + 1).cast("string")).alias("reference"), "source.*")
