"""Catalogue filters, search, sorting, paging, latest-version joins and record checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions import numbers
from foliarc.functions.text import fold_case, non_blank, strip, tokens
from foliarc.session import durable

FACT_VALUE_FIELDS = ["type", "name", "value_text", "value_number", "unit", "event_date", "assertion_status"]
SORT_KEYS = {"created_at", "document_date", "title", "status"}


# ---- filters -----------------------------------------------------------------------------
def contains_literal(text: Column, needle: str) -> Column:
    """Case-insensitive substring; %, _ and backslash in the needle mean themselves."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def search_condition(text: Column, query: str, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Web-style search: words are ANDed, ``or`` separates alternatives, ``-`` excludes, quotes keep phrases.

    ``normalise`` is applied to every token of both sides (:func:`stem_lookup`, for instance); a token that
    becomes empty is a stop word and counts on neither side.
    """
    fix = normalise or (lambda word: word)
    used = (lambda words: F.filter(F.transform(words, fix), lambda w: w != "")) if normalise else (lambda words: words)
    found = used(tokens(text))
    alternatives: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            alternatives.append([])
        elif phrase or word:
            alternatives[-1].append((bool(minus), phrase or word))
    options = []
    for terms in alternatives:
        checks = []
        for negative, term in terms:
            wanted = used(tokens(F.lit(term)))
            joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
            hit = F.contains(joined, F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" ")))
            stopped = F.size(wanted) == 0  # nothing but stop words: says nothing
            checks.append(stopped | (~hit if negative else hit) if normalise else ~hit if negative else hit)
        if checks:
            condition = checks[0]
            for check in checks[1:]:
                condition = condition & check
            options.append(condition)
    if not options:
        return F.lit(False)
    result = options[0]
    for option in options[1:]:
        result = result | option
    return result


def stem_lookup(stems: DataFrame, query: str) -> Callable[[Column], Column]:
    """``normalise`` for :func:`search_condition` from a dictionary table ``stems`` (word, stem; an empty stem: stop word).

    Only the forms that share a stem with a word of the query matter, and the stop words: that small part of
    the dictionary becomes a literal map, so texts are searched where they lie. Other words stand for themselves.
    """
    spark = stems.sparkSession
    asked = spark.range(1).select(F.explode_outer(tokens(F.lit(query))).alias("word")).distinct()
    wanted = stems.join(F.broadcast(asked), "word", "left_semi").select("stem").distinct()
    forms = stems.join(F.broadcast(wanted), "stem", "left_semi").unionByName(stems.filter("stem = ''")).select("word", "stem").distinct().orderBy("word").collect()
    if not forms:
        return lambda word: word
    known = F.create_map(*[F.lit(v) for r in forms for v in (r["word"], r["stem"])])
    return lambda word: F.coalesce(F.try_element_at(known, word), word)


def documents_query(docs: DataFrame, *, q: str | None = None, type: str | None = None, tag: str | None = None,
                    status: str | None = None, date_from: str | None = None, date_to: str | None = None,
                    deleted: str = "false", stems: DataFrame | None = None) -> DataFrame:
    """Catalogue filter; ``deleted`` is 'false', 'true' or 'all'; ``stems`` lets a search find inflected forms."""
    if date_from and date_to and date_from > date_to:
        raise ValueError("INVALID_PERIOD")
    if deleted == "true":
        docs = docs.filter(F.col("deleted_at").isNotNull())
    elif deleted != "all":
        docs = docs.filter(F.col("deleted_at").isNull())
    if q and q.strip():
        docs = docs.filter(search_condition(F.col("search_text"), q, stem_lookup(stems, q) if stems is not None else None) | contains_literal(F.col("title"), q))
    if type:
        docs = docs.filter(F.col("document_type") == type)
    if tag:
        docs = docs.filter(F.array_contains("tags", tag))
    if status:
        docs = docs.filter(F.col("status") == status)
    if date_from:
        docs = docs.filter(F.col("document_date") >= F.lit(date_from).cast("date"))
    if date_to:
        docs = docs.filter(F.col("document_date") <= F.lit(date_to).cast("date"))
    return docs


Order = list[tuple[str, bool]]  # columns, each with whether it ascends; NULLs come last either way


def document_order(key: str = "created_at", ascending: bool = False) -> Order:
    """The user's sort key, ties by document_id."""
    if key not in SORT_KEYS:
        raise ValueError("INVALID_SORT")
    return [(key, ascending), ("document_id", True)]


def ordering(order: Order) -> list[Column]:
    return [F.asc_nulls_last(name) if up else F.desc_nulls_last(name) for name, up in order]


def sort_documents(docs: DataFrame, key: str = "created_at", ascending: bool = False) -> DataFrame:
    return docs.orderBy(*ordering(document_order(key, ascending)))


def rows_after(rows: DataFrame, order: Order, last: tuple | None) -> DataFrame:
    """The rows that follow ``last``, the sort values of a row: the filter of a page token."""
    if last is None:
        return rows
    beyond, same = F.lit(False), F.lit(True)
    for (name, up), value in zip(order, last):
        column = F.col(name)
        if value is not None:
            further = column > F.lit(value) if up else column < F.lit(value)
            beyond = beyond | (same & (F.coalesce(further, F.lit(False)) | column.isNull()))
        same = same & column.eqNullSafe(F.lit(value))
    return rows.filter(beyond)


def next_page(rows: DataFrame, order: Order, last: tuple | None = None, page_size: int = 20) -> DataFrame:
    """The page after the row with the sort values ``last`` (the first page without): a heap of one page's rows.

    The last column of ``order`` names a row; the values of a page's last row are the token of the next page.
    """
    if not 1 <= page_size <= 100:
        raise ValueError("INVALID_PAGE")
    return rows_after(rows, order, last).orderBy(*ordering(order)).limit(page_size)


def token_before(rows: DataFrame, order: Order, page: int, page_size: int = 20) -> tuple | None:
    """The token of a page that is jumped to: sort values of the row before it; None before the first page.

    Keys are sorted in ranges and counted, and the one range that holds the row is read; no task holds the
    rows that are skipped. Past the end it is the last row's token.
    """
    if page < 1:
        raise ValueError("INVALID_PAGE")
    skipped = (page - 1) * page_size
    if not skipped:
        return None
    names, columns = [name for name, _ in order], ordering(order)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*names).repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)
    placed = durable(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each range
    for r in counts:
        if skipped <= r["count"] or r is counts[-1]:
            at = (r["part"] << 33) + min(skipped, r["count"]) - 1
            return tuple(placed.filter(F.col("__at") == at).select(*names).first())
        skipped -= r["count"]
    return None


def page_of(rows: DataFrame, order: Order, page: int = 1, page_size: int = 20) -> DataFrame:
    """A numbered page: its token, then :func:`next_page`."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("INVALID_PAGE")
    return next_page(rows, order, token_before(rows, order, page, page_size), page_size)


# ---- sets and keys -----------------------------------------------------------------------
def restrict_to(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is listed in ``ids``, each once however often it is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def union_ids(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The distinct ids of two tables with the column ``key``."""
    return first.select(key).union(second.select(key)).distinct()


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct wanted ids that are not present; NULL counts as an id."""
    return wanted.select(key).subtract(present.select(key))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of equal ``keys`` by ``order``, with ``copies``: combined before the exchange, so a hot key costs one row a task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first, F.count(F.lit(1)).alias("copies")).select("_row.*", "copies")


def capped(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, overflow): the first ``limit`` rows of each key, and for the others a row of keys and ``overflow``, their number.

    The window's limit reaches the map side; the counts are a combined aggregate.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    kept = rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")
    over = rows.groupBy(*keys).agg((F.count(F.lit(1)) - limit).alias("overflow")).filter("overflow > 0")
    return kept, over


def running_offset(rows: DataFrame, keys: list[str], order: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: what the sizes of a key's earlier rows sum to."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def chronological(rows: DataFrame, keys: list[str], date: str, ties: list[str], name: str = "place") -> DataFrame:
    """Adds ``name``: the place by date within ``keys``, undated rows last."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last(date), *ties)))


def in_period(date: Column, date_from: Column, date_to: Column) -> Column:
    """With a bound set, undated rows are out; without one every row is in."""
    open_ended = date_from.isNull() & date_to.isNull()
    inside = (date_from.isNull() | (date >= date_from)) & (date_to.isNull() | (date <= date_to))
    return open_ended | F.coalesce(date.isNotNull() & inside, F.lit(False))


def readable_documents(docs: DataFrame, revisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Live documents that are READY or whose active revision was built from the current text."""
    active = revisions.select(F.col("revision_id").alias("active_revision_id"), "text_revision_id")
    versions = texts.select("text_revision_id", F.col("version").alias("active_text_version"))
    return (
        docs.filter(F.col("deleted_at").isNull())
        .join(active, "active_revision_id", "left").join(versions, "text_revision_id", "left")
        .filter((F.col("status") == "READY")
                | F.coalesce(F.col("active_text_version") == F.col("text_version"), F.lit(False))))


# ---- fact predicates ---------------------------------------------------------------------
def fact_snapshot(prefix: str = "") -> Column:
    """The eight reviewed fields of a fact as one value."""
    return F.struct(*[F.col(prefix + name).alias(name) for name in [*FACT_VALUE_FIELDS, "review_status"]])


def differs_from_source(original: str = "original") -> Column:
    """Any of the seven value fields differs, NULL equal to NULL."""
    changed = F.lit(False)
    for name in FACT_VALUE_FIELDS:
        changed = changed | ~F.col(name).eqNullSafe(F.col(f"{original}.{name}"))
    return changed


def correction_eligible(status: Column) -> Column:
    return status.isin("CONFIRMED", "CORRECTED")


def reviewed_context_eligible(active: Column, status: Column) -> Column:
    return active & status.isin("CONFIRMED", "CORRECTED", "REJECTED")


def fact_description(value_text: Column, value_number: Column, unit: Column) -> Column:
    """Text, number and unit joined, NULL and empty parts skipped."""
    whole = value_number == F.floor(value_number)
    number = F.when(whole & (F.abs(value_number) < 1e15), value_number.cast("bigint").cast("string")).otherwise(
        value_number.cast("string"))
    parts = F.filter(F.array(value_text, number, unit), lambda part: part.isNotNull() & (part != ""))
    return F.array_join(parts, " ")


# ---- latest versions ---------------------------------------------------------------------
def latest_per(df: DataFrame, keys: list[str], newest: str, tie: str, ascending_tie: bool = True) -> DataFrame:
    """Newest row per key. A combined aggregate, so a key holding most rows stays cheap."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    if ascending_tie:
        is_time = dict(df.dtypes)[newest].startswith("timestamp")
        age = -(F.unix_micros(newest) if is_time else F.col(newest).cast("double"))
        best = df.groupBy(*keys).agg(
            F.min_by(row, F.struct(age.isNull().alias("undated"), age.alias("age"), F.col(tie))).alias("_row"))
    else:
        best = df.groupBy(*keys).agg(F.max_by(row, F.struct(newest, tie)).alias("_row"))
    return best.select(*keys, "_row.*")


def facts_text_version(docs: DataFrame, revisions: DataFrame, texts: DataFrame, runs: DataFrame) -> DataFrame:
    """document_id, facts_version: the active revision's text version, else the latest READY run's."""
    active = revisions.select(F.col("revision_id").alias("active_revision_id"), "text_revision_id")
    versions = texts.select("text_revision_id", F.col("version").alias("active_version"))
    ready = latest_per(runs.filter("status = 'READY'").select("document_id", "run_id", "created_at",
                                                              F.col("text_version").alias("run_version")),
                       ["document_id"], "created_at", "run_id", ascending_tie=False)
    return (
        docs.select("document_id", "text_version", "active_revision_id")
        .join(active, "active_revision_id", "left").join(versions, "text_revision_id", "left")
        .join(ready.select("document_id", "run_version"), "document_id", "left")
        .select("document_id", "text_version",
                F.when(F.col("active_revision_id").isNotNull(), F.col("active_version"))
                .otherwise(F.col("run_version")).alias("facts_version")))


def current_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with the content of their current text version (NULL when none is stored)."""
    versions = texts.select("document_id", F.col("version").alias("text_version"), "text_revision_id", "content")
    return docs.join(versions, ["document_id", "text_version"], "left")


def current_ir(ir: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Newest source representation of each live document's current text."""
    live = docs.filter(F.col("deleted_at").isNull()).select("document_id", F.col("text_version").alias("version"))
    now = texts.join(live, ["document_id", "version"], "left_semi").select("document_id", "text_revision_id")
    return latest_per(ir.join(now, ["document_id", "text_revision_id"], "left_semi"), ["document_id"],
                      "created_at", "ir_id")


def current_artifact(artifact: Column, deleted: Column, status: Column, run_status: Column, run_version: Column,
                     text_version: Column, active_run: Column, run_id: Column) -> Column:
    """The artifact, only when it belongs to the READY current text and the active run."""
    current = (deleted.isNull() & (status == "READY") & (run_status == "READY") & (run_version == text_version)
               & (active_run.isNull() | (active_run == run_id)))
    return F.when(current, artifact)


def search_text(title: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")),
                       F.coalesce(content, F.lit("")))


def revision_notice(status: Column, text_version: Column, facts_version: Column, active_text_is_current: Column,
                    has_prepared: Column) -> Column:
    """Message class about facts of an earlier text or a newer processing run; NULL when there is none."""
    earlier = facts_version.isNotNull() & (text_version > 0) & (facts_version != text_version)
    return (
        F.when(earlier & (status == "FAILED"), F.lit("EARLIER_TEXT_FAILED"))
        .when(earlier, F.lit("EARLIER_TEXT"))
        .when(~F.coalesce(active_text_is_current, F.lit(False)), F.lit(None).cast("string"))
        .when(status == "FAILED", F.lit("NEW_PROCESSING_FAILED"))
        .when(has_prepared | status.isin(vocab.PENDING_STATUSES), F.lit("NEW_PROCESSING_PENDING")))


# ---- tags --------------------------------------------------------------------------------
def normalize_tags(tags: Column) -> Column:
    """Trimmed, blanks dropped, first spelling kept once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip),
                                     lambda tag: tag != ""))


def rename_tag(docs: DataFrame, old: str, new: str) -> DataFrame:
    changed = F.transform("tags", lambda tag: F.when(tag == old, F.lit(new.strip())).otherwise(tag))
    return docs.withColumn("tags", F.when(F.array_contains("tags", old), changed).otherwise(F.col("tags")))


def delete_tag(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn("tags", F.array_remove("tags", name))


def tag_catalogue(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("name")).distinct().orderBy("name")


# ---- record checks -----------------------------------------------------------------------
def violations(rules: Iterable[tuple[str, Column]]) -> Column:
    """Codes of the rules whose condition does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))


def sized(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high) & non_blank(text)


def _tags_ok(tags: Column) -> Column:
    return tags.isNull() | ((F.size(tags) <= 30) & F.forall(tags, lambda tag: F.length(tag).between(1, 80)))


def note_violations() -> Column:
    """New note: title, type, text, document_date (text), tags."""
    return violations([
        ("TITLE", sized(F.col("title"), 1, 200)),
        ("DOCUMENT_TYPE", F.col("document_type").isin(vocab.NOTE_TYPES)),
        ("TEXT", sized(F.col("text"), 3, 200000)),
        ("DOCUMENT_DATE", numbers.is_valid_date_or_null(F.col("document_date"))),
        ("TAGS", _tags_ok(F.col("tags")))])


def document_edit_violations() -> Column:
    """Edit: a NULL field is left alone."""
    def given(name: str, check: Column) -> Column:
        return F.col(name).isNull() | check

    return violations([
        ("TITLE", given("title", sized(F.col("title"), 1, 200))),
        ("DOCUMENT_TYPE", given("document_type", F.col("document_type").isin(vocab.DOCUMENT_TYPES))),
        ("DOCUMENT_DATE", numbers.is_valid_date_or_null(F.col("document_date"))),
        ("TEXT", given("text", sized(F.col("text"), 3, 200000))),
        ("SUMMARY", given("summary", F.length("summary") <= 10000)),
        ("TAGS", _tags_ok(F.col("tags")))])


def fact_edit_violations() -> Column:
    def given(name: str, check: Column) -> Column:
        return F.col(name).isNull() | check

    number = F.col("value_number").cast("double")
    return violations([
        ("NAME", given("name", sized(F.col("name"), 1, 300))),
        ("VALUE_TEXT", given("value_text", F.length("value_text") <= 10000)),
        ("VALUE_NUMBER", given("value_number", ~F.isnan(number) & (F.abs(number) < float("inf")))),
        ("UNIT", given("unit", F.length("unit") <= 100)),
        ("EVENT_DATE", numbers.is_valid_date_or_null(F.col("event_date").cast("string"))),
        ("TYPE", given("type", F.col("type").isin(vocab.FACT_TYPES))),
        ("ASSERTION_STATUS", given("assertion_status", F.col("assertion_status").isin(vocab.ASSERTION_STATUSES))),
        ("REVIEW_STATUS", given("review_status", F.col("review_status").isin(vocab.REVIEW_STATUSES)))])


def question_violations() -> Column:
    return violations([
        ("QUESTION", sized(F.col("question"), 3, 4000)),
        ("DATE_FROM", numbers.is_valid_date_or_null(F.col("date_from"))),
        ("DATE_TO", numbers.is_valid_date_or_null(F.col("date_to"))),
        ("PERIOD", F.col("date_from").isNull() | F.col("date_to").isNull()
         | (F.col("date_from") <= F.col("date_to")))])


def response_violations() -> Column:
    return violations([("MODEL", sized(F.col("model"), 1, 200)), ("CONTENT", sized(F.col("content"), 1, 100000))])


def export_safe(text: Column) -> Column:
    """Local references masked: internal ids, paths and file names."""
    for pattern, label in vocab.EXPORT_RULES:
        text = F.regexp_replace(text, pattern, label)
    return text


def same_folded(a: Column, b: Column) -> Column:
    return fold_case(a) == fold_case(b)


def sets_equal(left: DataFrame, right: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, same: whether both sides hold the same members; no set is gathered."""
    sides = left.select(*keys, member, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, member, F.lit(0).alias("l"), F.lit(1).alias("r")))
    pairs = sides.groupBy(*keys, member).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return pairs.groupBy(*keys).agg(F.bool_and(F.col("l") == F.col("r")).alias("same"))
