"""Scores of predictions against gold rows: tuples, fields, classes, occurrences and summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.numbers import ratio
from foliarc.functions.text import fold_case, norm, occurrences, plain, span_text
from foliarc.session import by_key, durable, fits_broadcast

SEMANTIC_CLASSES = {
    "kind": vocab.STATEMENT_KINDS, "subject": vocab.SUBJECTS, "assertion": vocab.ASSERTIONS,
    "medication_state": [s for s in vocab.MEDICATION_STATES if s != "NOT_APPLICABLE"],
    "temporality": vocab.TEMPORALITIES,
}


# ---- multiset scoring --------------------------------------------------------------------
def multiset_counts(gold: DataFrame, predicted: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """group, tp, fp, fn where equal tuples match at most as often as both sides hold them.

    Repeats are counted before the exchange, so one tuple holding most rows costs one row.
    """
    sides = gold.select(*group, *key, F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        predicted.select(*group, *key, F.lit(0).alias("_g"), F.lit(1).alias("_p")))
    per_key = sides.groupBy(*group, *key).agg(F.sum("_g").alias("g"), F.sum("_p").alias("p"))
    matched = F.least("g", "p")
    return per_key.groupBy(*group).agg(
        F.sum(matched).alias("tp"), F.sum(F.col("p") - matched).alias("fp"), F.sum(F.col("g") - matched).alias("fn"))


def field_counts(gold: DataFrame, predicted: DataFrame, group: list[str], identity: list[str],
                 fields: list[str]) -> DataFrame:
    """group, field, tp, fp, fn; every field is keyed by the identity, so swapped values never match.

    All fields are counted in one pass over unpivoted rows.
    """
    def unpivot(df: DataFrame) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        return df.select(*group, *identity, F.explode(entries).alias("e")).select(
            *group, *identity, "e.field", "e.value")

    return multiset_counts(unpivot(gold), unpivot(predicted), [*group, "field"], [*identity, "value"])


def class_counts(gold: DataFrame, predicted: DataFrame, group: list[str], identity: list[str],
                 fields: list[str]) -> DataFrame:
    """group, field, label, tp, fp, fn per class label."""
    def unpivot(df: DataFrame) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])
        return df.select(*group, *identity, F.explode(entries).alias("e")).select(
            *group, *identity, "e.field", "e.label")

    return multiset_counts(unpivot(gold), unpivot(predicted), [*group, "field", "label"], identity)


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision and recall; NULL where nothing was predicted or expected."""
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def macro_f1(classes: DataFrame, group: list[str]) -> DataFrame:
    """group, field, macro_f1 over labels with any count; ``classes`` as :func:`class_counts`."""
    totals = classes.groupBy(*group, "field", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    weight = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return totals.groupBy(*group, "field").agg(
        F.round(F.avg(F.try_divide((2 * F.col("tp")).cast("double"), weight.cast("double"))), 6).alias("macro_f1"))


# ---- one-to-one pairing ------------------------------------------------------------------
def unique_pairs(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Conservative pairing of (group, gold_idx, pred_idx) candidates.

    A prediction pairs only with its single candidate; of several such predictions of one gold
    the earliest wins. Two combined aggregates, no window.
    """
    single = candidates.groupBy(*group, "pred_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("gold_idx").alias("gold_idx")).filter("n = 1")
    return single.groupBy(*group, "gold_idx").agg(F.min("pred_idx").alias("pred_idx"))


def exact_pairs(gold: DataFrame, predicted: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Greedy first-come pairing where the match is equality of ``key``: k-th gold with k-th prediction."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        order = W.partitionBy(*group, *key).orderBy(name)
        return df.select(*group, *key, name, F.row_number().over(order).alias("_k"))

    right = numbered(predicted, "pred_idx").select(*[F.col(c).alias(f"r_{c}") for c in [*group, *key, "_k"]], "pred_idx")
    left = numbered(gold, "gold_idx")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in [*group, *key, "_k"]])
    return left.join(right, same).select(*group, "gold_idx", "pred_idx")


def greedy_pairs(candidates: DataFrame, group: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy one-to-one pairing in gold order, best score first, earliest prediction on ties.

    ``candidates``: group, gold_idx, pred_idx, score; the columns of ``carry`` stay with their pair. The rows are
    sorted inside partitions of the group key and read as a stream: a task keeps only the current group's taken
    predictions.
    """
    names = [*group, "gold_idx", "pred_idx", *carry]
    ordered = by_key(candidates.select(*names, "score"), *group).sortWithinPartitions(
        *group, "gold_idx", F.desc("score"), "pred_idx").drop("score")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, last = None, set(), None
        for rows in batches:
            kept = []
            keys = zip(*[rows[c] for c in group])
            for at, (key, gold_idx, pred_idx) in enumerate(zip(keys, rows["gold_idx"], rows["pred_idx"])):
                if key != current:
                    current, used, last = key, set(), None
                if gold_idx != last and pred_idx not in used:
                    used.add(pred_idx)
                    last = gold_idx
                    kept.append(at)
            yield rows.iloc[kept]

    return ordered.mapInPandas(assign, ordered.schema)


def shared_fields(fields: list[str]) -> Column:
    """How many of ``fields`` agree between g.* and p.*."""
    total = F.lit(0)
    for name in fields:
        total = total + F.coalesce(F.col(f"g.{name}").eqNullSafe(F.col(f"p.{name}")), F.lit(False)).cast("int")
    return total


def quotes_overlap(a: Column, b: Column) -> Column:
    """Either quotation contains the other, markup and case aside."""
    return (plain(a) != "") & (F.contains(plain(b), plain(a)) | F.contains(plain(a), plain(b)))


GRAM = 8  # characters by which quotations meet
GRAM_SAMPLE = 4096
COMMON_GRAMS = 1 << 16


def _common_grams(quotes: DataFrame) -> DataFrame:
    """The grams that a bounded sample of quotations repeats, with their counts: they only steer which gram is taken."""
    rows = quotes.count()
    some = quotes.sample(fraction=min(1.0, GRAM_SAMPLE / max(1, rows)), seed=5)
    return some.select(F.explode_outer(F.array_distinct(_grams(F.col("_q")))).alias("gram")).groupBy("gram").count().filter(
        "count > 1").orderBy(F.desc("count"), "gram").limit(COMMON_GRAMS)


def _grams(text: Column) -> Column:
    """All substrings of ``GRAM`` characters; a shorter text is its own only one."""
    return F.when(F.length(text) <= GRAM, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))


def containing_pairs(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gold_idx, pred_idx of rows whose normalised quotations contain one another, within equal keys.

    Both sides: keys, idx, quote. The contained quotation is looked up by one gram of its own, the one that a
    sample finds least often, among all grams of the others; then the pair is checked. Quotations that share
    keys but no such gram never meet, so a key may hold a third of the rows. Those shorter than a gram
    meet by their whole length. A NULL quotation pairs with nothing, an empty one with all of its keys.
    """
    def side(df: DataFrame) -> DataFrame:
        rows = df.select(*keys, "idx", norm(F.col("quote")).alias("_q")).filter(F.col("quote").isNotNull())
        return durable(rows.withColumn("_row", F.monotonically_increasing_id()))

    g, p = side(gold), side(predicted)
    common = g.sparkSession.sparkContext.broadcast({r["gram"]: r["count"] for r in _common_grams(g.select("_q").unionByName(p.select("_q"))).collect()})

    @F.pandas_udf("string")
    def rarest(texts: pd.Series) -> pd.Series:
        known = common.value

        def pick(text: str) -> str:
            grams = [text[i:i + GRAM] for i in range(max(1, len(text) - GRAM + 1))]
            return min(grams, key=lambda v: (known.get(v, 0), v))
        return texts.map(pick)

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        """_short, _long: rows whose gram meets; texts follow only for these."""
        anchored = short.select(*keys, F.col("_row").alias("_short"), rarest("_q").alias("_gram"))
        lengths = [r[0] for r in anchored.select(F.length("_gram")).distinct().orderBy(F.length("_gram")).collect()]  # 0 to GRAM
        windows = F.array_distinct(F.flatten(F.array(*[_windows(F.col("_q"), n) for n in lengths]))) if lengths else F.array().cast("array<string>")
        wanted = anchored.select(F.col("_gram").alias("_w")).distinct()
        wanted = F.broadcast(wanted) if fits_broadcast(wanted, 64) else wanted
        placed = long.select(*keys, F.col("_row").alias("_long"), F.explode_outer(windows).alias("_gram")).join(
            wanted, F.col("_gram") == F.col("_w"), "left_semi")
        met = anchored.join(placed, [*keys, "_gram"]).select("_short", "_long")
        one, two = (df.select(F.col("_row").alias(f"_{name}"), F.col("_q").alias(f"_{name}_q")) for df, name in ((short, "short"), (long, "long")))
        return met.join(one, "_short").join(two, "_long").filter(F.contains("_long_q", F.col("_short_q"))).select("_short", "_long")

    rows = inside(p, g).select(F.col("_long").alias("_g"), F.col("_short").alias("_p")).unionByName(
        inside(g, p).select(F.col("_short").alias("_g"), F.col("_long").alias("_p"))).distinct()
    left = g.select(*keys, F.col("_row").alias("_g"), F.col("idx").alias("gold_idx"))
    right = p.select(F.col("_row").alias("_p"), F.col("idx").alias("pred_idx"))
    return rows.join(left, "_g").join(right, "_p").select(*keys, "gold_idx", "pred_idx")


def _windows(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, none of a shorter text."""
    if n == 0:
        return F.array(F.lit(""))
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def legacy_coverage(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """document_id, expected, matched: partial-gold coverage by quote containment, one fact per gold row.

    Both sides: document_id, idx, type, assertion_status, value_number, unit, source_text.
    """
    g = gold.select("document_id", "type", "assertion_status", F.col("idx").alias("gold_idx"), F.col("value_number").alias("gn"),
                    norm(F.col("unit")).alias("gu"), F.col("unit").alias("gunit"), norm(F.col("source_text")).alias("gq"))
    p = facts.select("document_id", "type", "assertion_status", F.col("idx").alias("pred_idx"), F.col("value_number").alias("pn"),
                     norm(F.col("unit")).alias("pu"), norm(F.col("source_text")).alias("pq"))
    fit = ((F.col("gq") != "") & (F.col("pq") != "") & (F.contains("gq", F.col("pq")) | F.contains("pq", F.col("gq")))
           & (F.col("gn").isNull() | (F.col("gn") == F.col("pn"))) & (F.col("gunit").isNull() | (F.col("gu") == F.col("pu"))))
    edges = g.join(p, ["document_id", "type", "assertion_status"]).filter(fit).select(
        "document_id", "type", "gold_idx", "pred_idx", F.lit(0).alias("score"))
    pairs = greedy_pairs(edges, ["document_id", "type"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("matched"))
    return gold.groupBy("document_id").agg(F.count(F.lit(1)).alias("expected")).join(
        pairs, "document_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


# ---- document scorers --------------------------------------------------------------------
LAB_FIELDS = ["test", "kind", "comparator", "value", "unit", "reference", "dates", "subject", "source"]
STATEMENT_FIELDS = ["name", *vocab.SEMANTIC_FIELDS, "source"]


def _same_norm(name: str) -> Column:
    """Equal up to case and blanks; values that are equal as they stand need no folding."""
    a, b = F.col(f"g.{name}"), F.col(f"p.{name}")
    return F.when(a.eqNullSafe(b), F.lit(True)).otherwise(norm(a) == norm(b))


def _lab_checks() -> dict[str, Column]:
    """Checks of a candidate, whose sides share the key already: the folded ``test``."""
    def same_number(a: str, b: str) -> Column:
        def number(c: str) -> Column:
            return F.translate(F.col(c), ", ", ".").try_cast("decimal(38,18)")
        return F.when(F.translate(F.col(a), ", ", ".").eqNullSafe(F.translate(F.col(b), ", ", ".")), F.lit(True)).otherwise(number(a).eqNullSafe(number(b)))

    words = F.split(plain(F.col("g.test")), " ")
    quote = plain(F.col("p.source_text"))
    source = ((F.col("p.page") == F.col("g.page")) & F.contains(quote, plain(F.col("g.result")))
              & (F.get(words, F.lit(0)) != "") & F.contains(quote, F.get(words, F.lit(0))))
    checks = {name: F.col(f"g.{name}").eqNullSafe(F.col(f"p.{name}")) for name in ("kind", "comparator", "dates", "subject")}
    checks |= {"test": F.lit(True)} | {name: _same_norm(name) for name in ("unit", "reference")}
    return checks | {"value": same_number("g.value", "p.value"), "source": F.coalesce(source, F.lit(False))}


def _statement_checks() -> dict[str, Column]:
    quote, sentence = plain(F.col("p.source_text")), plain(F.col("g.source_text"))
    source = (F.col("p.page") == F.col("g.page")) & (quote != "") & (
        (quote == sentence) | (F.contains(sentence, quote) & F.contains(quote, norm(F.col("g.name")))))
    checks = {name: F.col(f"g.{name}").eqNullSafe(F.col(f"p.{name}")) for name in vocab.SEMANTIC_FIELDS}
    return checks | {"name": F.lit(True), "source": F.coalesce(source, F.lit(False))}  # the folded name is the key


def _score(gold: DataFrame, predicted: DataFrame, name: str, checks: dict[str, Column], extra: Column,
           critical: Column) -> dict[str, DataFrame]:
    g = gold.select("case", norm(F.col(name)).alias("_key"), F.col("idx").alias("gold_idx"),
                    F.struct(*gold.columns).alias("g"))
    p = predicted.select("case", norm(F.col(name)).alias("_key"), F.col("idx").alias("pred_idx"),
                         F.struct(*predicted.columns).alias("p"))
    shared = [c for c in gold.columns if c in predicted.columns and c not in ("case", "idx")]
    alone = F.count(F.lit(1)).over(W.partitionBy("case", "_key")) == 1
    # Every candidate is judged once; what follows reads flags, not texts. The sides meet as plain columns, not
    # structs, so only what a check reads is exchanged and what is constant is not exchanged at all.
    left, right = (df.withColumn("_key", norm(F.col(name))).alias(side) for df, side in ((gold, "g"), (predicted, "p")))
    met = left.join(right, (F.col("g.case") == F.col("p.case")) & (F.col("g._key") == F.col("p._key")))
    edges = durable(met.select(
        F.col("g.case").alias("case"), F.col("g._key").alias("_key"), F.col("g.idx").alias("gold_idx"), F.col("p.idx").alias("pred_idx"), shared_fields(shared).alias("score"), extra.alias("alike"), critical.alias("critical"),
        F.array(*[F.coalesce(ok, F.lit(False)) for ok in checks.values()]).alias("oks")).withColumn("alone", alone), "edges")

    def chosen(rows: DataFrame) -> DataFrame:
        """A candidate alone under its key is its own pairing; only the others are walked."""
        kept = ["case", "gold_idx", "pred_idx", "critical", "oks"]
        walked = greedy_pairs(rows.filter("NOT alone"), ["case", "_key"], ("critical", "oks"))
        return rows.filter("alone").select(*kept).unionByName(walked.select(*kept))

    judged = chosen(edges.filter("alike"))
    pairs = judged.select("case", "gold_idx", "pred_idx")
    strict = chosen(edges.filter(F.forall("oks", lambda ok: ok)).withColumn("score", F.lit(0)))
    parts = ("gold", "predicted", "tp", "critical")

    def counted(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("case", *[given.get(c, F.lit(0)).cast("bigint").alias(c) for c in parts])

    one = F.lit(1)
    sizes = counted(gold, gold=one).unionByName(counted(predicted, predicted=one))
    tallies = sizes.unionByName(counted(strict, tp=one)).unionByName(
        counted(judged, critical=F.coalesce("critical", F.lit(0)))).groupBy("case").agg(*[F.sum(c).alias(c) for c in parts])
    sizes = sizes.groupBy("case").agg(F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"))
    paired = pairs.join(g.drop("_key"), ["case", "gold_idx"]).join(p.drop("_key"), ["case", "pred_idx"])
    field_rows = judged.select("case", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.get("oks", F.lit(i)).alias("ok")) for i, f in enumerate(checks)]))
        .alias("e")).groupBy("case", F.col("e.field").alias("field")).agg(F.count_if("e.ok").alias("tp"))
    every = sizes.select("case", "gold", "predicted", F.explode(F.array(*[F.lit(f) for f in checks])).alias("field"))
    fields = every.join(field_rows, ["case", "field"], "left").select(
        "case", "field", F.coalesce("tp", F.lit(0)).alias("tp"),
        (F.col("predicted") - F.coalesce("tp", F.lit(0))).alias("fp"),
        (F.col("gold") - F.coalesce("tp", F.lit(0))).alias("fn"))
    totals = tallies.select("case", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
                            (F.col("gold") - F.col("tp")).alias("fn"), "critical")
    return {"totals": totals, "fields": fields, "pairs": pairs, "paired": paired}


def score_lab(gold: DataFrame, predicted: DataFrame) -> dict[str, DataFrame]:
    """totals (case, tp, fp, fn, critical), fields and pairs of laboratory rows.

    Both sides: case, idx, test, kind, comparator, value, unit, reference, dates, subject, page;
    gold adds result, predictions source_text. A case without predictions keeps its gold as fn.
    """
    checks = _lab_checks()
    number = F.translate(F.col("p.value"), ", ", ".").try_cast("decimal(38,18)")
    wrong = ~checks["value"] | (F.col("p.comparator").isNotNull() & ~checks["comparator"]) | (
        F.col("p.unit").isNotNull() & ~checks["unit"])
    return _score(gold, predicted, "test", checks, F.lit(True), F.when(number.isNotNull() & wrong, 1).otherwise(0))


def critical_promotion(strict_subject: bool = False) -> Column:
    """Unsafe promotions of one pair: an unconfirmed finding confirmed, a medicine wrongly taken."""
    confirmed = ((F.col("p.subject") == "PATIENT") & (F.col("p.assertion") == "CONFIRMED")
                 & ~((F.col("g.subject") == "PATIENT") & (F.col("g.assertion") == "CONFIRMED")))
    taking = F.col("p.medication_state") == "TAKING"
    if strict_subject:
        taking = taking & (F.col("p.kind") == "MEDICATION") & ~(
            (F.col("g.subject") == F.col("p.subject")) & (F.col("g.medication_state") == "TAKING"))
    else:
        taking = taking & (F.col("g.medication_state") != "TAKING")
    return F.coalesce(confirmed, F.lit(False)).cast("int") + F.coalesce(taking, F.lit(False)).cast("int")


def score_statements(gold: DataFrame, predicted: DataFrame) -> dict[str, DataFrame]:
    """totals, fields, pairs and classes of statements.

    Both sides: case, idx, name, the five fields, source_text, page.
    """
    parts = _score(gold, predicted, "name", _statement_checks(),
                   quotes_overlap(F.col("p.source_text"), F.col("g.source_text")), critical_promotion())
    fields = [f for f in vocab.SEMANTIC_FIELDS if f != "kind"]

    def labels(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select("case", F.explode(F.array(*[F.struct(
            F.lit(f).alias("field"), F.col(prefix + f).alias("label")) for f in fields])).alias("e")).select(
            "case", "e.field", "e.label").filter(F.col("label").isNotNull())

    hits = parts["paired"].select("case", F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f"g.{f}").alias("label"), (F.col(f"g.{f}") == F.col(f"p.{f}")).alias("ok"))
        for f in fields])).alias("e")).filter("e.ok").select("case", "e.field", "e.label")
    rows = (labels(gold, "").withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).withColumn("h", F.lit(0))
            .unionByName(labels(predicted, "").withColumn("g", F.lit(0)).withColumn("p", F.lit(1)).withColumn("h", F.lit(0)))
            .unionByName(hits.withColumn("g", F.lit(0)).withColumn("p", F.lit(0)).withColumn("h", F.lit(1))))
    classes = rows.groupBy("case", "field", "label").agg(
        F.sum("h").alias("tp"), (F.sum("p") - F.sum("h")).alias("fp"), (F.sum("g") - F.sum("h")).alias("fn"))
    return parts | {"classes": classes}


def critical_by_name(gold: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """group, critical: promotions judged against every gold row of the same name.

    Gold is reduced to flags per name first, so the join is one row per prediction.
    """
    flags = gold.groupBy(*group, fold_case(F.col("name")).alias("_name")).agg(
        F.bool_or((F.col("subject") == "PATIENT") & (F.col("assertion") == "CONFIRMED")).alias("confirmed"),
        F.collect_set(F.when(F.col("medication_state") == "TAKING", F.col("subject"))).alias("takers"))
    joined = predicted.withColumn("_name", fold_case(F.col("name"))).join(flags, [*group, "_name"])
    bad = (F.col("subject") == "PATIENT") & (F.col("assertion") == "CONFIRMED") & ~F.col("confirmed")
    taking = ((F.col("kind") == "MEDICATION") & (F.col("medication_state") == "TAKING")
              & ~F.array_contains("takers", F.col("subject")))
    return joined.groupBy(*group).agg(F.sum(bad.cast("int") + taking.cast("int")).alias("critical"))


def score_semantics(gold: DataFrame, predicted: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """Scores aligned by source occurrence and name, never by predicted status.

    Both sides: case, idx, name, the five fields, source_text; predictions may carry page_index,
    start_byte, end_byte. ``texts``: case, text. Returns totals, classes, differences, unmatched.
    """
    def located(df: DataFrame) -> DataFrame:
        return df.join(texts.select("case", F.col("text").alias("_text")), "case", "left").withColumn(
            "_ranges", occurrences(F.col("_text"), F.col("source_text")))

    g = located(gold)
    only = F.when(F.size("_ranges") == 1, F.get("_ranges", F.lit(0)))
    g = g.select("case", fold_case(F.col("name")).alias("_name"), F.col("idx").alias("gold_idx"),
                 only.alias("g_span"), F.struct(*[c for c in gold.columns]).alias("g"))
    p = located(predicted)
    if "start_byte" in predicted.columns:
        proven = (F.coalesce("page_index", F.lit(0)) == 0) & (F.col("start_byte") < F.col("end_byte")) & (
            span_text(F.col("_text"), F.col("start_byte"), F.col("end_byte")) == F.col("source_text"))
        given = F.struct(F.col("start_byte").cast("int").alias("start_byte"), F.col("end_byte").cast("int").alias("end_byte"))
        only = F.when(F.col("start_byte").isNotNull(), F.when(proven, given)).otherwise(only)
    p = p.select("case", fold_case(F.col("name")).alias("_name"), F.col("idx").alias("pred_idx"),
                 only.alias("p_span"), F.struct(*[c for c in predicted.columns]).alias("p"))
    edges = overlapping_spans(
        g.filter("g_span IS NOT NULL").select("case", "_name", "gold_idx", F.col("g_span.start_byte").alias("l_start"),
                                              F.col("g_span.end_byte").alias("l_end")),
        p.filter("p_span IS NOT NULL").select("case", "_name", "pred_idx", F.col("p_span.start_byte").alias("r_start"),
                                              F.col("p_span.end_byte").alias("r_end")),
        ["case", "_name"]).select("case", "gold_idx", "pred_idx")
    pairs = unique_pairs(edges, ["case"])
    paired = pairs.join(g.select("case", "gold_idx", "g"), ["case", "gold_idx"]).join(
        p.select("case", "pred_idx", "p"), ["case", "pred_idx"])
    same = reduce(lambda a, b: a & b, [F.col(f"g.{f}") == F.col(f"p.{f}") for f in vocab.SEMANTIC_FIELDS])
    quote = F.col("g.source_text") == F.col("p.source_text")
    hits = paired.groupBy("case").agg(F.count_if(same).alias("tp"), F.count(F.lit(1)).alias("aligned"),
                                      F.count_if(quote).alias("exact_quotes"),
                                      F.sum(critical_promotion(strict_subject=True)).alias("critical"))
    ambiguous = edges.groupBy("case", "pred_idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("case").agg(
        F.count(F.lit(1)).alias("ambiguous"))
    sizes = gold.select("case", F.lit(1).alias("gold"), F.lit(0).alias("pred")).unionByName(
        predicted.select("case", F.lit(0).alias("gold"), F.lit(1).alias("pred"))).groupBy("case").agg(
        F.sum("gold").alias("gold"), F.sum("pred").alias("pred"))
    joined = sizes.join(hits, "case", "left").join(ambiguous, "case", "left").na.fill(0)
    totals = joined.select(
        "case", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), "critical",
        "aligned", "exact_quotes", (F.col("pred") - F.col("aligned")).alias("unmatched_actual"), "ambiguous")
    differing = F.array_compact(F.array(*[F.when(F.col(f"g.{f}") != F.col(f"p.{f}"), F.lit(f)) for f in vocab.SEMANTIC_FIELDS],
                                        F.when(~quote, F.lit("source_text"))))
    differences = paired.select("case", "gold_idx", differing.alias("fields")).filter(F.size("fields") > 0)
    unmatched = g.select("case", "gold_idx").join(pairs, ["case", "gold_idx"], "left_anti")

    def labels(rows: DataFrame, prefix: str, column: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(f).alias("field"), F.when(
            (F.lit(f) != "medication_state") | (F.col(prefix + "kind") == "MEDICATION"), F.col(prefix + f)).alias("label"))
            for f in vocab.SEMANTIC_FIELDS])
        flat = rows.select("case", F.explode(entries).alias("e")).select("case", "e.field", "e.label")
        known = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("label").isin(names)
                                            for f, names in SEMANTIC_CLASSES.items()])
        return flat.filter(known).select("case", "field", "label", F.lit(column).alias("side"))

    agreed = paired.select("case", "p", F.struct(*[F.when(
        (F.col(f"g.{f}") == F.col(f"p.{f}")) & ((F.lit(f) != "medication_state") | (F.col("g.kind") == "MEDICATION")),
        F.col(f"g.{f}")).alias(f) for f in vocab.SEMANTIC_FIELDS if f != "kind"],
        F.when(F.col("g.kind") == F.col("p.kind"), F.col("g.kind")).alias("kind"),
        F.col("p.kind").alias("pkind")).alias("a"))
    hit_entries = F.array(*[F.struct(F.lit(f).alias("field"), F.when(
        (F.lit(f) != "medication_state") | (F.col("a.pkind") == "MEDICATION"), F.col(f"a.{f}")).alias("label"))
        for f in vocab.SEMANTIC_FIELDS])
    hit_rows = agreed.select("case", F.explode(hit_entries).alias("e")).select("case", "e.field", "e.label").filter(
        F.col("label").isNotNull() & (F.col("label") != "NOT_APPLICABLE")).withColumn("side", F.lit("h"))
    rows = labels(gold, "", "g").unionByName(labels(predicted, "", "p")).unionByName(hit_rows)
    tp, found, wanted = (F.count_if(F.col("side") == s) for s in ("h", "p", "g"))
    classes = rows.groupBy("case", "field", "label").agg(
        tp.alias("tp"), (found - tp).alias("fp"), (wanted - tp).alias("fn"))
    return {"totals": totals, "classes": classes, "differences": differences, "unmatched": unmatched}


def released_subset(statements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Statements a second reading agreed with; gold keeps its full denominator in the score."""
    agreed = verdicts.filter("status = 'AGREES'").select("document_id", "statement_index")
    return statements.join(agreed, ["document_id", "statement_index"], "left_semi")


# ---- summaries ---------------------------------------------------------------------------
def summarise(results: DataFrame) -> DataFrame:
    """Totals per split and for all splits, per type and repeat.

    ``results``: split, type, repeat, measured, scored, expected, tp, fp, fn, critical, reason,
    seconds. A failed document stays in the denominator; an unmeasured one is only counted.
    """
    sets = results.groupingSets(
        [[F.col("split"), F.col("type"), F.col("repeat")], [F.col("type"), F.col("repeat")]],
        "split", "type", "repeat")
    measured = F.col("measured")
    out = sets.agg(
        F.grouping("split").alias("g"), F.count(F.lit(1)).alias("documents"), F.count_if("measured").alias("measured_n"),
        F.count_if(~measured).alias("not_measured"), F.count_if(measured & F.col("scored")).alias("scored"),
        *[F.sum(F.when(measured, F.col(c))).alias(c) for c in ("expected", "tp", "fp", "fn", "critical")],
        F.round(F.sum(F.when(measured, F.col("seconds"))), 2).alias("seconds"))
    return with_ratios(out.withColumn("split", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("split")))
                       .drop("g").withColumnRenamed("measured_n", "measured"))


def failure_reasons(results: DataFrame, group: list[str]) -> DataFrame:
    """group, reasons: a map of reason to count (counted first, so the map is small)."""
    counts = results.filter(F.col("reason").isNotNull()).groupBy(*group, "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def percentiles(values: DataFrame, group: list[str], column: str, quantiles: dict[str, float],
                buckets: int = 256, levels: int = 2, ordered: int = 65_536) -> DataFrame:
    """group, n, total and nearest-rank percentiles with half-even ranks.

    Values are counted first; a group with up to ``ordered`` distinct ones is put in order. At each
    level the distinct values of a larger group are parted at their approximate quantiles, so
    buckets are even whatever the outliers, and the counts per bucket tell which one holds the
    rank. Only the last bucket's values are put in order.
    """
    rows = values.filter(F.col(column).isNotNull()).select(*group, F.col(column).alias("v"))
    distinct = durable(rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("copies")))
    at = {name: F.bround(F.lit(q) * (F.col("n") - 1)).cast("bigint") for name, q in quantiles.items()}
    stats = distinct.groupBy(*group).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.col("v") * F.col("copies")).alias("total"))
    stats = durable(stats.select("*", *[rank.alias(f"_{name}") for name, rank in at.items()]))
    # Ranks stand beside a group's values: no row for each value and quantile.
    small = stats.filter(F.col("d") <= ordered).select(*group, *[f"_{name}" for name in quantiles])
    upto = F.sum("copies").over(W.partitionBy(*group).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    reached = distinct.join(small, group).withColumn("_upto", upto)
    picked = reached.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") > F.col(f"_{name}"), F.col("v"))).alias(name) for name in quantiles])
    large = stats.filter(F.col("d") > ordered)
    if not large.isEmpty():
        picked = picked.unionByName(_percentiles_by_buckets(distinct, large, group, quantiles, buckets, levels))
    return stats.select(*group, "n", "total").join(picked, group)


def _percentiles_by_buckets(distinct: DataFrame, large: DataFrame, group: list[str], quantiles: dict[str, float], buckets: int, levels: int) -> DataFrame:
    """group and a column for each quantile: the buckets of :func:`percentiles` for groups with many distinct values."""
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{name}").alias("rank")) for name in quantiles])
    asked = large.select(*group, F.explode(ranks).alias("t")).select(*group, "t.name", "t.rank")
    open_values = distinct.join(asked, group)
    key = [*group, "name"]
    points = [i / buckets for i in range(1, buckets)]
    before = W.partitionBy(*key).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    for _ in range(levels):
        bounds = open_values.groupBy(*key).agg(F.percentile_approx("v", points, 40 * buckets).alias("bounds"))
        placed = open_values.join(bounds, key).withColumn(
            "b", F.size(F.filter(F.array_distinct("bounds"), lambda x: x < F.col("v")))).drop("bounds")
        sizes = placed.groupBy(*key, "b").agg(F.sum("copies").alias("size"), F.first("rank").alias("rank")).withColumn(
            "before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        chosen = sizes.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("size"))).select(*key, "b", "before")
        open_values = placed.join(chosen, [*key, "b"]).withColumn("rank", F.col("rank") - F.col("before")).drop("b", "before")
    inside = W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    reached = open_values.withColumn("upto", F.sum("copies").over(inside)).filter(F.col("upto") > F.col("rank"))
    return reached.groupBy(*group).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles])


def overlapping_spans(left: DataFrame, right: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Pairs of half-open spans that overlap under equal ``keys``.

    ``left``: keys, l_start, l_end and more; ``right``: keys, r_start, r_end and more. Spans are cut
    into cells of ``width``; a pair is met only in shared cells and kept in the first of them.
    """
    def cells(df: DataFrame, start: str, end: str) -> DataFrame:
        first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
        return df.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(first, last)))

    joined = cells(left, "l_start", "l_end").join(cells(right, "r_start", "r_end"), [*keys, "_cell"])
    return joined.filter(
        (F.greatest("l_start", "r_start") < F.least("l_end", "r_end"))
        & (F.col("_cell") == F.floor(F.greatest("l_start", "r_start") / width))).drop("_cell")


def summarise_semantics(totals: DataFrame, classes: DataFrame, group: list[str]) -> DataFrame:
    """Eight counters and macro F1 per group (a repeat); ``totals`` and ``classes`` carry the group."""
    names = ["tp", "fp", "fn", "critical", "aligned", "exact_quotes", "unmatched_actual", "ambiguous"]
    sums = totals.groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])
    scores = macro_f1(classes, group).groupBy(*group).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "macro_f1")))).alias("macro_f1"))
    return sums.join(scores, group, "left")


# ---- adapters ----------------------------------------------------------------------------
def unique_dates(dates: DataFrame) -> DataFrame:
    """document_id, dates: 'ROLE=iso' of the roles with one distinct date."""
    per = dates.groupBy("document_id", "role").agg(F.min("iso").alias("low"), F.max("iso").alias("high")).filter("low = high")
    return per.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws("=", "role", "low"))), ",").alias("dates"))


def lab_scorer_rows(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Annotated rows in the scorer's shape; a page without a number counts by position."""
    return rows.join(unique_dates(dates), "document_id", "left").select(
        F.col("document_id").alias("case"), F.col("row_index").alias("idx"), F.col("name").alias("test"), "kind",
        "comparator", F.col("numeric_value").alias("value"), "unit", "reference",
        F.coalesce("dates", F.lit("")).alias("dates"), "subject",
        F.coalesce("page_number", F.col("page_index") + 1).alias("page"), "source_text")


def legacy_lab_rows(facts: DataFrame) -> DataFrame:
    """Plain facts in the scorer's shape: the patient's, without comparator, reference or date role."""
    number = F.col("value_number")
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", number), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return facts.select(
        F.col("document_id").alias("case"), "idx", F.col("name").alias("test"),
        F.when(number.isNotNull(), F.lit("NUMERIC")).alias("kind"), F.lit(None).cast("string").alias("comparator"),
        F.when(number.isNotNull(), text).alias("value"), "unit", F.lit(None).cast("string").alias("reference"),
        F.when(F.col("event_date").isNotNull(), F.concat(F.lit("UNSPECIFIED="), F.col("event_date").cast("string")))
        .otherwise(F.lit("")).alias("dates"), F.lit("PATIENT").alias("subject"), F.coalesce("page", F.lit(1)).alias("page"),
        "source_text")


def legacy_statements(facts: DataFrame) -> DataFrame:
    medication = F.col("type") == "MEDICATION"
    status = F.coalesce("assertion_status", F.lit("UNKNOWN"))
    return facts.select(
        F.col("document_id").alias("case"), "idx", "name", F.col("type").alias("kind"), F.lit("PATIENT").alias("subject"),
        F.when(medication | (status == "PRESCRIBED"), F.lit("UNKNOWN")).otherwise(status).alias("assertion"),
        F.when(medication, F.when(status == "PRESCRIBED", F.lit("PRESCRIBED")).otherwise(F.lit("UNKNOWN")))
        .otherwise(F.lit("NOT_APPLICABLE")).alias("medication_state"), F.lit(None).cast("string").alias("temporality"),
        F.coalesce("page", F.lit(1)).alias("page"), "source_text")


def printed_gold(rows: DataFrame) -> DataFrame:
    """Gold rows with kind, comparator and exact number read from the printed result."""
    from foliarc.functions.numbers import parse_result

    parsed = rows.withColumn("_r", parse_result(F.col("result_raw")))
    return parsed.select(
        *rows.columns, F.coalesce(F.when(F.col("_r.kind") == "NUMERIC", F.lit("NUMERIC")), F.lit("QUALITATIVE")).alias("result_kind"),
        F.when(F.col("_r.kind") == "NUMERIC", F.col("_r.comparator")).alias("comparator"), F.col("_r.numeric_value").alias("numeric_value"))
