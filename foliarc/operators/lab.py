"""Laboratory reports: typed rows, dates, subject lines and issues, checked against the source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.numbers import iso_date, lab_date, parse_result
from foliarc.functions.text import (LINE_BREAK, SPACE, collapse, contains_command, fold_case, let, lines_keeping_breaks, non_blank,
                                    span_text, strip, strip_left, words)
from foliarc.session import by_key


def cells(line: Column) -> Column:
    """Cells of a pipe or tab line; NULL for other lines."""
    piped = F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|", -1), strip)
    tabbed = F.transform(F.split(line, "\t", -1), strip)
    return F.when(F.contains(line, F.lit("|")), piped).when(F.contains(line, F.lit("\t")), tabbed)


def is_header(parts: Column, names: list[list[str]]) -> Column:
    check = F.size(parts) == len(names)
    for i, allowed in enumerate(names):
        check = check & fold_case(F.get(parts, F.lit(i))).isin(allowed)
    return F.coalesce(check, F.lit(False))


def date_role(label: Column) -> Column:
    """RESULT, SPECIMEN or STUDY of a folded date label; NULL for any other."""
    roles = F.create_map(*[F.lit(v) for pair in vocab.DATE_LABELS.items() for v in pair])
    return F.try_element_at(roles, label)


def labelled_fields(line: Column) -> Column:
    """[name, result, unit, reference] of ``name: result unit; reference ...; flag``; else NULL."""
    body = strip(F.regexp_extract(line, vocab.LAB_LABELLED, 2))
    measured = strip(F.regexp_extract(body, "^" + vocab.RESULT, 0))
    unit = strip(F.substring(body, F.length(F.regexp_extract(body, "^" + vocab.RESULT, 0)) + 1, F.length(body)))
    known = line.rlike(vocab.LAB_LABELLED) & (measured != "") & ((unit == "") | unit.rlike(vocab.LAB_UNIT))
    return F.when(known, F.array(strip(F.regexp_extract(line, vocab.LAB_LABELLED, 1)), measured, unit,
                                 strip(F.regexp_extract(line, vocab.LAB_LABELLED, 3))))


def source_lines(docs: DataFrame) -> DataFrame:
    """document_id, page_index, page_number, line_no, raw for every physical line."""
    pages = docs.select("document_id", F.posexplode("pages").alias("page_index", "page"))
    return pages.select("document_id", "page_index", F.col("page.page_number").alias("page_number"),
                        F.posexplode_outer(lines_keeping_breaks(F.col("page.text"))).alias("line_no", "raw")).filter(
        "raw IS NOT NULL")


def first_line(pages: Column) -> Column:
    """First line with visible text: breaks are blanks too, so what follows the leading blanks begins it."""
    texts = F.filter(F.transform(pages, lambda p: strip_left(p["text"])), lambda t: t != "")
    return strip(F.regexp_extract(F.get(texts, F.lit(0)), f"^(?:(?!{LINE_BREAK})(?s:.))*", 0))


def is_lab_report(pages: Column) -> Column:
    return F.coalesce(first_line(pages).rlike(vocab.LAB_TITLE), F.lit(False))


def annotated_lines(docs: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Every classified line of the laboratory reports; rows beyond ``row_limit``, if given, are marked so.

    ``kind`` is ROW, DATE, SUBJECT, INVALID_DATE, UNSUPPORTED_ROW, UNSUPPORTED_CONTENT or ROW_LIMIT;
    lines of no interest are dropped. Documents are exchanged before they are cut into lines, and the bare
    lines are sorted before anything is derived from them: that one order serves every window.
    """
    reports = by_key(docs.select("document_id", "pages"), "document_id").filter(is_lab_report(F.col("pages")))
    lines = source_lines(reports).sortWithinPartitions("document_id", "page_index", "line_no")
    page = W.partitionBy("document_id", "page_index").orderBy("line_no")
    before = page.rowsBetween(W.unboundedPreceding, -1)
    lines = (
        lines.withColumn("text", F.rtrim(F.col("raw"), F.lit("\r\n")))
        .withColumn("bare", strip(F.col("text"))).withColumn("parts", cells(F.col("text")))
        .withColumn("start_byte", F.coalesce(F.sum(F.octet_length("raw")).over(before), F.lit(0)).cast("int"))
        .withColumn("end_byte", (F.col("start_byte") + F.octet_length("text")).cast("int"))
        .withColumn("header", is_header(F.col("parts"), vocab.LAB_HEADERS) & ~F.col("bare").rlike(vocab.LAB_TITLE))
        # A table is open from its header to a blank line or the end of the page.
        .withColumn("mark", F.when(F.col("bare") == "", F.lit(0)).when(F.col("header"), F.lit(1)))
        .withColumn("in_table", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0)) == 1))
    rule = F.coalesce(F.forall("parts", lambda c: c.rlike(r"^:?-+:?\z")), F.lit(False))
    lines = lines.filter((F.col("bare") != "") & ~F.col("bare").rlike(vocab.LAB_TITLE) & ~F.col("header") & ~rule)
    label = F.when(F.contains("bare", F.lit(":")), fold_case(F.substring_index("bare", ":", 1)))
    value = F.substring(F.col("bare"), F.locate(":", F.col("bare")) + 1, F.length("bare"))
    lines = lines.withColumn("role", date_role(label)).withColumn("date", F.when(F.col("role").isNotNull(), lab_date(value)))
    subject = (F.length("bare") <= 32) & fold_case(F.col("bare")).isin(vocab.SUBJECT_LINES)
    plain_row = F.col("bare").rlike(r"(?iu);\s*референс" + vocab.NOT_BEFORE_WORD)
    candidate = F.col("role").isNull() & ~subject & (F.col("in_table") | plain_row)
    fields = F.when(~candidate | contains_command(F.col("text")), F.lit(None)).when(
        F.col("in_table"), F.when(F.size("parts") == 4, F.col("parts"))).otherwise(labelled_fields(F.col("bare")))
    lines = lines.withColumn("candidate", candidate).withColumn("fields", fields)
    named = (F.get("fields", F.lit(0)) != "") & (F.length(F.get("fields", F.lit(0))) <= 200)
    lines = lines.withColumn("result", F.when(named, parse_result(F.get("fields", F.lit(1)))))
    accepted = F.col("result").isNotNull()
    order = W.partitionBy("document_id").orderBy("page_index", "line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("row_number", F.when(accepted, F.sum(accepted.cast("int")).over(order)).cast("int"))
    whole = W.partitionBy("document_id")
    lines = lines.withColumn("patient", F.max(subject).over(whole))
    over = F.lit(False) if row_limit is None else F.col("row_number") > row_limit
    kind = (
        F.when(F.col("date").isNotNull(), F.lit("DATE")).when(F.col("role").isNotNull(), F.lit("INVALID_DATE"))
        .when(subject, F.lit("SUBJECT")).when(over, F.lit("ROW_LIMIT"))
        .when(accepted, F.lit("ROW")).when(F.col("candidate"), F.lit("UNSUPPORTED_ROW"))
        .otherwise(F.lit("UNSUPPORTED_CONTENT")))
    return lines.select("document_id", "page_index", "page_number", "line_no", "start_byte", "end_byte", "text",
                        kind.alias("kind"), "candidate", "role", "date", "fields", "result", "row_number", "patient")


def lab_dates(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'DATE'").select("document_id", "role", F.col("date.iso").alias("iso"),
                                                F.col("date.raw").alias("raw"), "page_index", "start_byte", "end_byte")


def lab_subjects(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'SUBJECT'").select("document_id", "page_index", "start_byte", "end_byte")


def lab_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """Accepted rows; a subject line anywhere in the report makes them the patient's."""
    return lines.filter("kind = 'ROW'").select(
        "document_id", F.col("row_number").alias("row_index"), F.get("fields", F.lit(0)).alias("name"), "result.*",
        F.nullif(F.get("fields", F.lit(2)), F.lit("")).alias("unit"),
        F.nullif(F.get("fields", F.lit(3)), F.lit("")).alias("reference"), "page_index", "page_number", "start_byte",
        "end_byte", F.col("text").alias("source_text"),
        F.when(F.col("patient"), F.lit("PATIENT")).otherwise(F.lit("UNKNOWN")).alias("subject"), *keep)


def dated(lines: DataFrame) -> DataFrame:
    """The lines with the event_date of ``event_dates``, decided inside the order they already have."""
    whole = W.partitionBy("document_id")

    def of(role: str) -> Column:
        return F.when((F.col("kind") == "DATE") & (F.col("role") == role), F.col("date.iso"))

    def only(role: str) -> Column:
        return F.when(F.min(of(role)).over(whole) == F.max(of(role)).over(whole), F.min(of(role)).over(whole))

    roles = sorted(set(vocab.DATE_LABELS.values()))
    conflict = reduce(lambda a, b: a | b, [F.coalesce(F.min(of(r)).over(whole) != F.max(of(r)).over(whole), F.lit(False)) for r in roles])
    bad = F.coalesce(F.max(F.col("kind") == "INVALID_DATE").over(whole), F.lit(False)) | conflict
    return lines.withColumn("event_date", F.when(
        ~bad, F.when(F.max(of("RESULT")).over(whole).isNotNull(), only("RESULT")).otherwise(only("STUDY"))))


def dated_rows(lines: DataFrame) -> DataFrame:
    """``lab_rows`` with their event_date."""
    return lab_rows(dated(lines), "event_date")


def lab_issues(lines: DataFrame) -> DataFrame:
    """document_id, code and span; a date conflict has no span."""
    found = lines.filter(F.col("kind").isin("INVALID_DATE", "UNSUPPORTED_ROW", "UNSUPPORTED_CONTENT", "ROW_LIMIT")).select(
        "document_id", F.col("kind").alias("code"), "page_index", "start_byte", "end_byte")
    per_role = lab_dates(lines).groupBy("document_id", "role").agg(
        (F.min("iso") != F.max("iso")).alias("conflict"))
    conflicts = per_role.filter("conflict").select("document_id").distinct().select(
        "document_id", F.lit("DATE_CONFLICT").alias("code"), F.lit(None).cast("int").alias("page_index"),
        F.lit(None).cast("int").alias("start_byte"), F.lit(None).cast("int").alias("end_byte"))
    return found.unionByName(conflicts)


def lab_summary(lines: DataFrame) -> DataFrame:
    """document_id, candidate_rows, accepted_rows, unresolved (unsupported content not counted)."""
    iso = [F.when((F.col("kind") == "DATE") & (F.col("role") == role), F.col("date.iso")) for role in sorted(set(vocab.DATE_LABELS.values()))]
    conflict = reduce(lambda a, b: a | b, [F.coalesce(F.min(day) != F.max(day), F.lit(False)) for day in iso])
    broken = F.count_if(F.col("kind").isin("INVALID_DATE", "UNSUPPORTED_ROW", "ROW_LIMIT"))
    return lines.groupBy("document_id").agg(
        F.count_if("candidate").alias("candidate_rows"), F.count_if(F.col("kind") == "ROW").alias("accepted_rows"),
        (broken + conflict.cast("bigint")).alias("unresolved"))


def event_dates(dates: DataFrame, issues: DataFrame) -> DataFrame:
    """document_id, event_date: the one RESULT date, else the one STUDY date; none after a date issue."""
    def only(role: str) -> Column:
        iso = F.when(F.col("role") == role, F.col("iso"))
        return F.when(F.min(iso) == F.max(iso), F.min(iso))

    per = dates.groupBy("document_id").agg(
        F.bool_or(F.col("role") == "RESULT").alias("has_result"), only("RESULT").alias("r"), only("STUDY").alias("s"))
    bad = issues.filter(F.col("code").isin("INVALID_DATE", "DATE_CONFLICT")).select("document_id").distinct()
    return per.join(bad, "document_id", "left_anti").select(
        "document_id", F.when(F.col("has_result"), F.col("r")).otherwise(F.col("s")).alias("event_date"))


def project_lab_facts(rows: DataFrame, dates: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """One LAB_RESULT fact per row; a bounded result never becomes a scalar. ``dated_rows`` need no dates and issues."""
    dated = rows if "event_date" in rows.columns else rows.join(event_dates(dates, issues), "document_id", "left")
    return dated.select("document_id", "row_index", *[c.alias(name) for name, c in _fact_fields().items()])


def _fact_fields() -> dict[str, Column]:
    return {"type": F.lit("LAB_RESULT"), "name": F.col("name"), "value_text": F.col("source_text"),
            "value_number": F.when(F.col("comparator") == "=", F.col("numeric_value").cast("double")), "unit": F.col("unit"),
            "event_date": F.col("event_date").cast("date"), "assertion_status": F.lit("CONFIRMED"),
            "confidence": F.lit(None).cast("double"), "page": F.col("page_number"), "source_text": F.col("source_text")}


def validate_lab(rows: DataFrame, dates: DataFrame, subjects: DataFrame, issues: DataFrame, facts: DataFrame,
                 docs: DataFrame, row_limit: int | None = None) -> DataFrame:
    """document_id, row_index, code for every broken rule of a stored laboratory artifact."""
    fact = ["type", "name", "value_text", "value_number", "unit", "event_date", "assertion_status", "page", "source_text"]
    row = [c for c in rows.columns if c not in ("document_id", "row_index", "event_date")]
    parts = {"row": rows.select("document_id", "row_index", F.struct(*row).alias("row")),
             "fact": facts.select("document_id", "row_index", F.struct(*fact).alias("fact")),
             "day": dates.select("document_id", F.lit(None).cast("int").alias("row_index"), F.struct(*dates.columns[1:]).alias("day"))}
    # Rows, facts and dates travel once, to their document: everything below keeps to that layout.
    mixed = by_key(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts.values()), "document_id")
    pair = W.partitionBy("document_id", "row_index")
    known = F.col("document_id").isNotNull() & F.col("row_index").isNotNull()
    met = mixed.withColumn("stored", F.when(known, F.collect_list("fact").over(pair))).withColumn(
        "extra", F.col("fact").isNotNull() & ~(known & (F.count("row").over(pair) > 0)))
    met = met.filter(F.col("fact").isNull() | F.col("extra")).drop("fact").withColumn(
        "stored", F.explode_outer(F.when(F.col("row").isNotNull(), F.col("stored"))))
    place = {c: F.coalesce(F.col("row")[c], F.col("day")[c]) for c in ("page_index", "start_byte", "end_byte")}
    same_span = W.partitionBy("document_id", *place.values())
    met = met.withColumn("copies", F.count("row").over(same_span))
    pages = docs.select("document_id", "pages", F.lit(True).alias("has_pages"))
    owned = subjects.select("document_id").distinct().withColumn("has_subject", F.lit(True))
    located = met.join(pages, "document_id", "left").join(owned, "document_id", "left").join(
        event_dates(dates, issues), "document_id", "left").withColumn(
        "found", span_text(F.get("pages", place["page_index"])["text"], place["start_byte"], place["end_byte"]))
    located = located.select("document_id", "row_index", "extra", "stored", "copies", "has_pages", "has_subject", "event_date", "found", "row", "day")
    own = located.select("*", *[F.col("row")[c].alias(c) for c in row])
    again = parse_result(F.col("raw"))
    # What a row should be stored as is written beside it: only its date comes from elsewhere.
    expected = F.struct(*[c.alias(name) for name, c in _fact_fields().items() if name in fact])
    text = F.col("source_text")
    rules = [
        ("SPAN", F.col("found") == text), ("NAME", F.contains(text, F.col("name")) & (F.col("name") != "")),
        ("RAW", F.contains(text, F.col("raw"))), ("UNIT", F.col("unit").isNull() | F.contains(text, F.col("unit"))),
        ("REFERENCE", F.col("reference").isNull() | F.contains(text, F.col("reference"))),
        ("RESULT", (again["kind"] == F.col("kind")) & again["comparator"].eqNullSafe(F.col("comparator"))
         & again["numeric_value"].cast("double").eqNullSafe(F.col("numeric_value").cast("double"))),
        ("SUBJECT", F.col("subject").isin("PATIENT", "UNKNOWN")
         & ((F.col("subject") != "PATIENT") | F.coalesce("has_subject", F.lit(False)))),
        ("DUPLICATE_SPAN", F.col("copies") == 1), ("PROJECTION", F.col("stored") == expected),
        ("ROW_LIMIT", F.lit(True) if row_limit is None else F.col("row_index") <= row_limit)]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    day = F.col("day")
    role = date_role(fold_case(F.substring_index(strip(F.col("found")), ":", 1)))
    good_date = (role == day["role"]) & F.contains("found", day["raw"]) & (
        lab_date(day["raw"])["iso"] == day["iso"]) & iso_date(day["iso"]).isNotNull()
    # A row or a date of a document that is not there has nothing to be held against.
    codes = (F.when(F.col("extra"), F.array(F.lit("EXTRA_FACT"))).when(F.col("has_pages").isNull(), F.array().cast("array<string>"))
             .when(F.col("row").isNotNull(), broken)
             .when(~F.coalesce(good_date, F.lit(False)), F.array(F.lit("DATE_ROLE"))))
    return own.select("document_id", "row_index", F.explode(codes).alias("code"))


def reconcile_readers(reader_rows: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, issues) of up to three independent readers of one table.

    ``reader_rows``: document_id, channel, row, test, result, unit, reference.
    ``origins``: document_id, text_layer_origin. Nothing is ever accepted automatically.
    """
    fields = ["test", "result", "unit", "reference"]
    counts = reader_rows.groupBy("document_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("document_id").agg(F.count(F.lit(1)).alias("channels"), F.min("n").alias("low"),
                                              F.max("n").alias("high"))
    # The fields of a row are compared side by side; only those that differ become rows.
    per_row = reader_rows.select("document_id", "row", *[collapse(F.col(f)).alias(f) for f in fields]).groupBy(
        "document_id", "row").agg(F.array_compact(F.array(*[F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields])).alias("differ"))
    differing = per_row.filter(F.size("differ") > 0).select("document_id", "row", F.explode("differ").alias("field"))
    aligned = sizes.filter("low = high").select("document_id")
    issues = differing.join(aligned, "document_id", "left_semi").select(
        "document_id", F.col("row").cast("bigint").alias("row"), "field").unionByName(
        sizes.filter("low <> high").select("document_id", F.lit(None).cast("bigint").alias("row"),
                                           F.lit("row_count").alias("field")))
    found = issues.groupBy("document_id").agg(F.count(F.lit(1)).alias("issues"))
    decisions = sizes.join(found, "document_id", "left").join(origins, "document_id", "left").select(
        "document_id", F.when(F.col("low") != F.col("high"), F.lit("REVIEW_ALIGNMENT"))
        .when(F.col("issues") > 0, F.lit("REVIEW_CONFLICT"))
        .when((F.col("channels") == 3) & (F.col("text_layer_origin") == "NATIVE"), F.lit("CONSISTENT_3"))
        .otherwise(F.lit("REVIEW_INSUFFICIENT")).alias("decision"),
        F.coalesce("issues", F.lit(0)).alias("issues"), F.lit(False).alias("automatically_accepted"))
    return decisions, issues


def audit_table_reader(expected: DataFrame, observed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(checks, mismatches) per table and run; both sides carry keys, row, test, result, unit, reference."""
    fields = ["test", "result", "unit", "reference"]

    def spread(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, "row", F.explode(F.map_from_entries(F.array(*[
            F.struct(F.lit(f).alias("k"), F.array_join(words(F.col(f)), " ").alias("v")) for f in fields])))
            .alias("field", name))

    left = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected_rows"))
    right = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed_rows"))
    sizes = left.join(right, keys, "left")
    same_size = sizes.filter("expected_rows = observed_rows").select(*keys)
    wrong = spread(expected, "want").join(spread(observed, "got"), [*keys, "row", "field"]).filter("want <> got").join(
        same_size, keys, "left_semi").select(*keys, F.col("row").cast("bigint").alias("row"), "field")
    unequal = sizes.filter(F.col("expected_rows") != F.coalesce("observed_rows", F.lit(0))).filter(
        F.col("observed_rows").isNotNull()).select(*keys, F.lit(None).cast("bigint").alias("row"),
                                                   F.lit("row_count").alias("field"))
    failed = sizes.filter(F.col("observed_rows").isNull()).select(
        *keys, F.lit(None).cast("bigint").alias("row"), F.lit("model_error").alias("field"))
    mismatches = wrong.unionByName(unequal).unionByName(failed)
    counts = mismatches.groupBy(*keys).agg(F.count(F.lit(1)).alias("mismatches"))
    checks = sizes.join(counts, keys, "left").select(
        *keys, "expected_rows", "observed_rows", F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
        F.when(F.col("observed_rows").isNull(), F.lit("ERROR")).when(F.col("mismatches") > 0, F.lit("REVIEW"))
        .otherwise(F.lit("PASS")).alias("status"))
    return checks, mismatches


def audit_totals(checks: DataFrame) -> DataFrame:
    status = F.col("status")
    return checks.agg(F.sum("expected_rows").alias("expected_rows"), F.count_if(status == "PASS").alias("passed"),
                      F.count_if(status == "REVIEW").alias("review"), F.count_if(status == "ERROR").alias("error"))


def supports_visit(pages: Column, cue_chars: int | None = None) -> Column:
    """A visit cue in the first paragraph, or in its first ``cue_chars`` characters."""
    first = F.get(F.filter(F.flatten(F.transform(
        pages, lambda p: F.split(p["text"], r"\n[ \t]*\n"))), non_blank), F.lit(0))
    head = F.regexp_replace(first, f"{SPACE}+", " ")
    if cue_chars is not None:
        head = F.substring(head, 1, cue_chars)
    return F.coalesce(head.rlike(vocab.VISIT_CUE), F.lit(False))


def route_document(pages: Column, profile: str = "clinical-v1", cue_chars: int | None = None) -> Column:
    """Extraction method of a document under a profile: lab, visit, visit-review or legacy."""
    method = F.lit("legacy")
    if profile in ("clinical-v1", "clinical-reviewed-v1"):
        name = "visit" if profile == "clinical-v1" else "visit-review"
        method = F.when(supports_visit(pages, cue_chars), F.lit(name)).otherwise(method)
    if profile != "legacy":
        method = F.when(is_lab_report(pages), F.lit("lab")).otherwise(method)
    return let(method, lambda m: m)
