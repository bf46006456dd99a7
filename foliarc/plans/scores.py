"""Scoring, stability, answer and manifest operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliarc.operators import answers, manifests, scoring, stability
from foliarc.plans.registry import TABLES, Tables, query

BIG = "bigint"


def gold(t: Tables):
    """Gold statements: one per line item, split by order status."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"))
    return t.lineitem.join(o, "l_orderkey").select(
        F.col("l_orderkey").alias("case"), "split", F.concat(F.lit("Part "), F.col("l_partkey")).alias("name"),
        F.col("l_suppkey").cast("string").alias("source_text"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), "l_discount", "l_tax", "l_quantity")


def predicted(t: Tables):
    """Predictions: some rows missing, some relabelled, some repeated."""
    g = gold(t).filter("l_tax < 0.08").withColumn("kind", F.when(
        F.col("l_discount") > 0.08, F.lit("X")).otherwise(F.col("kind")))
    return g.withColumn("copy", F.explode(F.when(F.col("l_quantity") > 45, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))))).drop("copy")


SIDES = """
g AS (SELECT l_orderkey AS "case", o_orderstatus AS split, 'Part ' || l_partkey AS name, CAST(l_suppkey AS VARCHAR) AS source_text,
  l_returnflag AS kind, l_linestatus AS status, l_linenumber AS line, l_discount, l_tax, l_quantity
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p0 AS (SELECT * REPLACE (CASE WHEN l_discount > 0.08 THEN 'X' ELSE kind END AS kind) FROM g WHERE l_tax < 0.08),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE l_quantity > 45)"""


def sql_counts(group: str, key: str) -> str:
    return f"""SELECT {group}, CAST(sum(least(a, b)) AS BIGINT) AS tp, CAST(sum(b - least(a, b)) AS BIGINT) AS fp,
  CAST(sum(a - least(a, b)) AS BIGINT) AS fn FROM (SELECT {group}, {key}, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM
  (SELECT {group}, {key}, count(*) AS a FROM g GROUP BY ALL) FULL JOIN
  (SELECT {group}, {key}, count(*) AS b FROM p GROUP BY ALL) USING ({group}, {key})) GROUP BY {group}"""


@query("agg_10_multiset_score", f"WITH {SIDES} " + sql_counts("split", 'name, source_text, kind, status, line, "case"'))
def agg_10(t: Tables):
    return scoring.multiset_counts(gold(t), predicted(t), ["split"],
                                   ["name", "source_text", "kind", "status", "line", "case"])


@query("set_7_multiset_intersection", f"""
WITH {SIDES} SELECT "case", name, kind, count(*) AS copies FROM (SELECT "case", name, kind FROM g
INTERSECT ALL SELECT "case", name, kind FROM p) GROUP BY ALL""")
def set_7(t: Tables):
    both = gold(t).select("case", "name", "kind").intersectAll(predicted(t).select("case", "name", "kind"))
    return both.groupBy("case", "name", "kind").agg(F.count(F.lit(1)).alias("copies"))


@query("agg_11_field_counts", f"WITH {SIDES} SELECT 'kind' AS field, * FROM (" + sql_counts(
    "split", '"case", name, source_text, kind') + ") UNION ALL SELECT 'status', * FROM (" + sql_counts(
    "split", '"case", name, source_text, status') + ")")
def agg_11(t: Tables):
    return scoring.field_counts(gold(t), predicted(t), ["split"], ["case", "name", "source_text"], ["kind", "status"])


@query("agg_12_class_counts", f"WITH {SIDES} SELECT 'kind' AS field, * RENAME (kind AS label) FROM (" + sql_counts(
    "split, kind", '"case", name, source_text') + ")")
def agg_12(t: Tables):
    return scoring.class_counts(gold(t), predicted(t), ["split"], ["case", "name", "source_text"], ["kind"])


@query("agg_13_macro_f1", f"""WITH {SIDES}, c AS (""" + sql_counts("split, kind", '"case", name, source_text') + """)
SELECT split, 'kind' AS field, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM c GROUP BY split""")
def agg_13(t: Tables):
    classes = scoring.class_counts(gold(t), predicted(t), ["split"], ["case", "name", "source_text"], ["kind"])
    return scoring.macro_f1(classes, ["split"])


@query("agg_18_precision_recall", f"WITH {SIDES}, c AS (" + sql_counts("split", '"case", name, kind') + """)
SELECT split, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def agg_18(t: Tables):
    return scoring.with_ratios(scoring.multiset_counts(gold(t), predicted(t), ["split"], ["case", "name", "kind"]))


@query("label_confusion", """
WITH l AS (SELECT doc_id, lang, quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id))
SELECT lang, count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality = 0 AND guess = 1) AS fp,
  count(*) FILTER (quality = 1 AND guess = 0) AS fn FROM l GROUP BY lang""")
def label_confusion(t: Tables):
    d = t.documents.select("doc_id", "lang", "n_chars")
    joined = t.labels.join(d, "doc_id")
    want = joined.filter("quality = 1").select("lang", "doc_id")
    have = joined.filter("n_chars > 1000").select("lang", "doc_id")
    return scoring.multiset_counts(want, have, ["lang"], ["doc_id"])


def _statements(t: Tables, side: str):
    """Line items as statements; predictions promote some findings."""
    confirmed = F.when(F.col("l_linestatus") == "O", F.lit("CONFIRMED")).otherwise(F.lit("SUSPECTED"))
    state = F.when(F.col("l_returnflag") != "A", F.lit("NOT_APPLICABLE")).when(
        F.col("l_tax") < 0.04, F.lit("TAKING")).otherwise(F.lit("PRESCRIBED"))
    if side == "predicted":
        confirmed = F.when(F.col("l_discount") > 0.07, F.lit("CONFIRMED")).otherwise(confirmed)
        state = F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.08), F.lit("TAKING")).otherwise(state)
    return t.lineitem.select(
        F.col("l_orderkey").alias("case"), F.concat(F.lit("Part "), F.col("l_partkey")).alias("name"),
        F.when(F.col("l_returnflag") == "A", F.lit("MEDICATION")).otherwise(F.lit("CONDITION")).alias("kind"),
        F.lit("PATIENT").alias("subject"), confirmed.alias("assertion"), state.alias("medication_state"))


@query("agg_14_critical_errors", """
WITH g AS (SELECT l_orderkey AS "case", l_partkey AS name, l_linestatus = 'O' AS c, l_returnflag = 'A' AND l_tax < 0.04 AS tk
  FROM lineitem),
f AS (SELECT "case", name, bool_or(c) AS c, bool_or(tk) AS tk FROM g GROUP BY ALL),
p AS (SELECT l_orderkey AS "case", l_partkey AS name, l_linestatus = 'O' OR l_discount > 0.07 AS c,
  l_returnflag = 'A' AND (l_tax < 0.04 OR l_discount > 0.08) AS tk FROM lineitem)
SELECT "case", CAST(sum((p.c AND NOT f.c)::INT + (p.tk AND NOT f.tk)::INT) AS BIGINT) AS critical
FROM p JOIN f USING ("case", name) GROUP BY "case" """)
def agg_14(t: Tables):
    return scoring.critical_by_name(_statements(t, "gold"), _statements(t, "predicted"), ["case"])


def _results(t: Tables):
    """Per order: a scored document."""
    flag = F.col("l_returnflag")
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(flag == "N").alias("tp"), F.count_if(flag == "R").alias("fp"), F.count_if(flag == "A").alias("fn"))
    return t.orders.join(per, "o_orderkey").select(
        F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("type"),
        F.month("o_orderdate").alias("repeat"), (F.col("o_totalprice") > 50000).alias("measured"),
        (F.col("o_totalprice") < 400000).alias("scored"), (F.col("tp") + F.col("fn")).alias("expected"), "tp", "fp", "fn",
        F.lit(0).cast(BIG).alias("critical"),
        F.when(F.col("o_totalprice") >= 400000, F.concat(F.lit("TOO_LARGE_"), "o_orderstatus")).alias("reason"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("seconds"))


@query("agg_15_split_summary", """
WITH per AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS tp, count(*) FILTER (l_returnflag = 'R') AS fp,
  count(*) FILTER (l_returnflag = 'A') AS fn FROM lineitem GROUP BY 1),
r AS (SELECT o_orderstatus AS split, o_orderpriority AS type, month(o_orderdate) AS repeat, o_totalprice > 50000 AS m,
  o_totalprice < 400000 AS s, tp, fp, fn FROM orders JOIN per ON l_orderkey = o_orderkey)
SELECT coalesce(split, 'all') AS split, type, CAST(repeat AS BIGINT) AS repeat, count(*) AS documents, count(*) FILTER (m) AS measured,
  count(*) FILTER (NOT m) AS not_measured, count(*) FILTER (m AND s) AS scored, CAST(sum(tp + fn) FILTER (m) AS BIGINT) AS expected,
  CAST(sum(tp) FILTER (m) AS BIGINT) AS tp, CAST(sum(fp) FILTER (m) AS BIGINT) AS fp, CAST(sum(fn) FILTER (m) AS BIGINT) AS fn,
  round(sum(tp) FILTER (m) / nullif(sum(tp + fp) FILTER (m), 0), 6) AS precision,
  round(sum(tp) FILTER (m) / nullif(sum(tp + fn) FILTER (m), 0), 6) AS recall
FROM r GROUP BY GROUPING SETS ((split, type, repeat), (type, repeat))""")
def agg_15(t: Tables):
    return scoring.summarise(_results(t)).withColumn("repeat", F.col("repeat").cast(BIG)).drop("critical", "seconds")


@query("agg_16_failure_reasons", """
SELECT o_orderpriority AS type, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (
  SELECT o_orderpriority, 'TOO_LARGE_' || o_orderstatus AS reason, count(*) AS n FROM orders
  WHERE o_totalprice >= 400000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL) GROUP BY 1""")
def agg_16(t: Tables):
    reasons = scoring.failure_reasons(_results(t), ["type"])
    return reasons.select("type", F.array_join(F.transform(
        F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("reasons"))


PERCENTILE = """list_sort(list({0}))[CAST(round_even({1} * (count({0}) - 1), 0) AS BIGINT) + 1]"""


@query("agg_17_nearest_rank", f"""
SELECT event_type, {PERCENTILE.format('value', 0.5)} AS p50, {PERCENTILE.format('value', 0.95)} AS p95 FROM events
GROUP BY event_type""")
def agg_17(t: Tables):
    return scoring.percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select(
        "event_type", "p50", "p95")


@query("agg_30_latency", f"""
SELECT user_id, round(sum(value), 2) AS total, {PERCENTILE.format('value', 0.5)} AS p50,
  {PERCENTILE.format('value', 0.95)} AS p95 FROM events GROUP BY user_id""")
def agg_30(t: Tables):
    return scoring.percentiles(t.events, ["user_id"], "value", {"p50": 0.5, "p95": 0.95}).select(
        "user_id", F.round("total", 2).alias("total"), "p50", "p95")


# ---- pairing -----------------------------------------------------------------------------
@query("jn_11_span_overlap", """
SELECT a.l_suppkey AS supplier, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey
AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'
AND greatest(a.l_partkey, b.l_partkey) < least(a.l_partkey + a.l_quantity, b.l_partkey + b.l_quantity) GROUP BY 1""")
def jn_11(t: Tables):
    def spans(status: str, side: str):
        return t.lineitem.filter(F.col("l_linestatus") == status).select(
            F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("name"), F.col("l_partkey").alias(f"{side}_start"),
            (F.col("l_partkey") + F.col("l_quantity").cast(BIG)).alias(f"{side}_end"))
    pairs = scoring.overlapping_spans(spans("O", "l"), spans("F", "r"), ["supplier", "name"], 64)
    return pairs.groupBy("supplier").agg(F.count(F.lit(1)).alias("pairs"))


@query("jn_12_quote_containment", """
WITH c AS (SELECT conv_id, turn, role, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM conversations)
SELECT a.conv_id, a.turn AS gold, b.turn AS found FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role = b.role
AND (contains(a.q, b.q) OR contains(b.q, a.q))""")
def jn_12(t: Tables):
    c = t.conversations.select("conv_id", "role", F.col("turn").alias("idx"), F.col("text").alias("quote"))
    pairs = scoring.containing_pairs(c, c, ["conv_id", "role"])
    return pairs.select("conv_id", F.col("gold_idx").alias("gold"), F.col("pred_idx").alias("found"))


@query("jn_17_exact_assignment", """
WITH g AS (SELECT l_orderkey AS "case", l_returnflag AS kind, l_partkey AS gold_idx, row_number() OVER (PARTITION BY l_orderkey,
  l_returnflag ORDER BY l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT l_orderkey AS "case", l_returnflag AS kind, l_partkey AS pred_idx, row_number() OVER (PARTITION BY l_orderkey,
  l_returnflag ORDER BY l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT "case", gold_idx, pred_idx FROM g JOIN p USING ("case", kind, k)""")
def jn_17(t: Tables):
    def side(status: str, name: str):
        return t.lineitem.filter(F.col("l_linestatus") == status).select(
            F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias(name))
    return scoring.exact_pairs(side("O", "gold_idx"), side("F", "pred_idx"), ["case"], ["kind"])


@query("jn_17_greedy_assignment", """
WITH RECURSIVE side AS (SELECT l_orderkey AS "case", concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS idx, l_linestatus, l_returnflag, l_linenumber, l_suppkey FROM lineitem),
e AS (SELECT g."case", g.idx AS gold_idx, p.idx AS pred_idx, (g.l_returnflag = p.l_returnflag)::INT + (g.l_linenumber = p.l_linenumber)::INT + (g.l_suppkey = p.l_suppkey)::INT AS score
  FROM side g JOIN side p ON g."case" = p."case" AND g.l_linestatus = 'O' AND p.l_linestatus = 'F'),
prefs AS (SELECT "case", gold_idx, list(pred_idx ORDER BY score DESC, pred_idx) AS wanted, row_number() OVER (PARTITION BY "case" ORDER BY gold_idx) AS r
  FROM e WHERE score > 0 GROUP BY "case", gold_idx),
walk AS (SELECT "case", gold_idx, r, wanted[1] AS pred_idx, [wanted[1]] AS used FROM prefs WHERE r = 1
  UNION ALL SELECT p."case", p.gold_idx, p.r, list_filter(p.wanted, lambda v: NOT list_contains(w.used, v))[1],
    list_append(w.used, list_filter(p.wanted, lambda v: NOT list_contains(w.used, v))[1])
  FROM walk w JOIN prefs p ON p."case" = w."case" AND p.r = w.r + 1)
SELECT "case", gold_idx, pred_idx FROM walk WHERE pred_idx IS NOT NULL""")
def jn_17_greedy(t: Tables):
    def side(status: str, name: str, prefix: str):
        return t.lineitem.filter(F.col("l_linestatus") == status).select(
            F.col("l_orderkey").alias("case"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias(name),
            F.struct("l_returnflag", "l_linenumber", "l_suppkey").alias(prefix))
    edges = side("O", "gold_idx", "g").join(side("F", "pred_idx", "p"), "case").withColumn(
        "score", scoring.shared_fields(["l_returnflag", "l_linenumber", "l_suppkey"])).filter("score > 0")
    return scoring.greedy_pairs(edges, ["case"])


@query("jn_18_unique_assignment", """
WITH e AS (SELECT a.l_orderkey AS "case", a.l_partkey AS gold_idx, b.l_partkey AS pred_idx FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'),
u AS (SELECT *, count(*) OVER (PARTITION BY "case", pred_idx) AS n FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY "case", gold_idx ORDER BY pred_idx) AS k FROM u WHERE n = 1)
SELECT "case", gold_idx, pred_idx FROM r WHERE k = 1""")
def jn_18(t: Tables):
    def side(status: str, name: str):
        return t.lineitem.filter(F.col("l_linestatus") == status).select(
            F.col("l_orderkey").alias("case"), "l_linenumber", F.col("l_partkey").alias(name))
    edges = side("O", "gold_idx").join(side("F", "pred_idx"), ["case", "l_linenumber"])
    return scoring.unique_pairs(edges, ["case"])


def _scored_statements(t: Tables, side: str):
    cols = t.conversations
    state = F.when(F.col("role") == "user", F.lit("TAKING")).otherwise(F.lit("NOT_APPLICABLE"))
    assertion = F.lit("UNKNOWN")
    if side == "gold":
        state = F.when((F.col("role") == "user") & (F.col("turn") == 0), F.lit("PRESCRIBED")).otherwise(state)
    rows = cols if side == "gold" else cols.filter("turn <> 1")
    return rows.select(
        F.col("conv_id").alias("case"), F.col("turn").alias("idx"), F.concat(F.lit("Turn "), "turn").alias("name"),
        F.when(F.col("role") == "user", F.lit("MEDICATION")).otherwise(F.lit("CONDITION")).alias("kind"),
        F.lit("PATIENT").alias("subject"), assertion.alias("assertion"), state.alias("medication_state"),
        F.lit("CURRENT").alias("temporality"), F.concat_ws(" ", F.lit("Turn"), F.col("turn").cast("string"), "text")
        .alias("source_text"), F.lit(1).alias("page"))


@query("score_statements", """
SELECT conv_id AS "case", count(*) FILTER (turn <> 1 AND NOT (role = 'user' AND turn = 0)) AS tp,
  count(*) FILTER (turn <> 1 AND role = 'user' AND turn = 0) AS fp, count(*) FILTER (turn = 1 OR (role = 'user' AND turn = 0)) AS fn,
  count(*) FILTER (role = 'user' AND turn = 0) AS critical FROM conversations GROUP BY 1""")
def score_statements(t: Tables):
    return scoring.score_statements(_scored_statements(t, "gold"), _scored_statements(t, "predicted"))["totals"]


def _conversation_texts(t: Tables):
    return t.conversations.groupBy(F.col("conv_id").alias("case")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(
            " ", F.lit("Turn"), F.col("turn").cast("string"), "text").alias("text")))), lambda p: p["text"]), "\n").alias("text"))


@query("score_semantics", """
SELECT conv_id AS "case", count(*) FILTER (turn <> 1 AND NOT (role = 'user' AND turn = 0)) AS tp,
  count(*) FILTER (role = 'user' AND turn = 0) AS critical, count(*) FILTER (turn <> 1) AS aligned,
  count(*) FILTER (turn <> 1) AS exact_quotes FROM conversations GROUP BY 1""")
def score_semantics(t: Tables):
    parts = scoring.score_semantics(_scored_statements(t, "gold"), _scored_statements(t, "predicted"), _conversation_texts(t))
    return parts["totals"].select("case", "tp", "critical", "aligned", "exact_quotes")


@query("agg_29_semantic_summary", """
SELECT 1::BIGINT AS repeat, count(*) FILTER (turn <> 1 AND NOT (role = 'user' AND turn = 0)) AS tp,
  count(*) FILTER (turn <> 1 AND role = 'user' AND turn = 0) AS fp, count(*) FILTER (turn = 1 OR (role = 'user' AND turn = 0)) AS fn,
  count(*) FILTER (role = 'user' AND turn = 0) AS critical FROM conversations""")
def semantic_summary(t: Tables):
    parts = scoring.score_semantics(_scored_statements(t, "gold"), _scored_statements(t, "predicted"), _conversation_texts(t))
    one = F.lit(1).cast(BIG).alias("repeat")
    return scoring.summarise_semantics(parts["totals"].select("*", one), parts["classes"].select("*", one), ["repeat"]).select(
        "repeat", "tp", "fp", "fn", "critical")


@query("score_lab", """
SELECT l_orderkey AS "case", count(*) FILTER (l_tax < 0.08 AND l_discount < 0.09) AS tp,
  count(*) FILTER (l_tax < 0.08 AND l_discount >= 0.09) AS fp, count(*) FILTER (NOT (l_tax < 0.08 AND l_discount < 0.09)) AS fn,
  count(*) FILTER (l_tax < 0.08 AND l_discount >= 0.09) AS critical FROM lineitem GROUP BY 1""")
def score_lab(t: Tables):
    quantity = F.col("l_quantity").cast("string")
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    base = t.lineitem.select(
        F.col("l_orderkey").alias("case"), key.alias("idx"), F.concat(F.lit("Part "), key).alias("test"),
        F.lit("NUMERIC").alias("kind"), F.lit("=").alias("comparator"), quantity.alias("value"), F.lit("mg").alias("unit"),
        F.lit("0-5").alias("reference"), F.lit("").alias("dates"), F.lit("UNKNOWN").alias("subject"), F.lit(1).alias("page"),
        quantity.alias("result"), "l_tax", "l_discount")
    found = base.filter("l_tax < 0.08").withColumn("value", F.when(
        F.col("l_discount") >= 0.09, F.lit("999")).otherwise(F.regexp_replace("value", r"\.", ","))).withColumn(
        "source_text", F.concat_ws(" | ", "test", "result")).drop("result", "l_tax", "l_discount")
    return scoring.score_lab(base.drop("l_tax", "l_discount"), found)["totals"]


@query("legacy_coverage", """
SELECT l_orderkey AS document_id, count(*) AS expected, count(*) FILTER (l_tax < 0.08) AS matched FROM lineitem GROUP BY 1""")
def legacy_coverage(t: Tables):
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("document_id"), key.alias("idx"), F.col("l_returnflag").alias("type"),
                             F.lit("UNKNOWN").alias("assertion_status"), F.col("l_quantity").alias("value_number"),
                             F.lit("mg").alias("unit"), F.concat(F.lit("<"), key, F.lit(">  Quote")).alias("source_text"), "l_tax")
    found = rows.filter("l_tax < 0.08").withColumn("source_text", F.lower(F.concat(F.lit("see "), "source_text")))
    return scoring.legacy_coverage(rows.drop("l_tax"), found.drop("l_tax"))


@query("gold_adapters", """
SELECT l_orderkey AS "case", CAST(l_quantity AS BIGINT)::VARCHAR AS value, 'UNSPECIFIED=' || strftime(l_shipdate, '%Y-%m-%d') AS dates,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def gold_adapters(t: Tables):
    facts = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.lit(0).alias("idx"), F.col("l_partkey").cast("string").alias("name"),
        F.col("l_quantity").alias("value_number"), F.lit("mg").alias("unit"), F.to_date("l_shipdate").alias("event_date"),
        F.lit(None).cast("int").alias("page"), F.lit("q").alias("source_text"))
    return scoring.legacy_lab_rows(facts).groupBy("case", "value", "dates").agg(F.count(F.lit(1)).alias("n"))


# ---- stability ---------------------------------------------------------------------------
def plan(t: Tables):
    return t.events.select(F.col("user_id").alias("run")).distinct().select(
        "run", F.when(F.col("run") < 60, F.lit("same")).otherwise(F.lit("fresh")).alias("group"), F.col("run").alias("place"))


def cases(t: Tables):
    names = ["click", "error", "purchase", "signup", "view"]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("case")) - 1
    return t.events.select(F.col("event_type").alias("case")).distinct().withColumn("place", place.cast("int"))


def results(t: Tables):
    """One result per user and event type, kept while every earlier type is present."""
    per = t.events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("case")).agg(
        (F.max("value") > 300).alias("passed"), (F.min("value") < 20).alias("evidence_pass"),
        F.max(F.when(F.col("value") > 480, F.lit("TimeoutError"))).alias("error_type"),
        F.round(F.sum("value"), 2).alias("seconds"), F.count(F.lit(1)).alias("n"))
    return per.join(cases(t), "case")


RESULTS = """
pl AS (SELECT DISTINCT user_id AS run, CASE WHEN user_id < 60 THEN 'same' ELSE 'fresh' END AS grp FROM events),
re AS (SELECT user_id AS run, event_type AS "case", max(value) > 300 AS passed, min(value) < 20 AS evidence_pass,
  max(CASE WHEN value > 480 THEN 'TimeoutError' END) AS error_type, round(sum(value), 2) AS seconds, count(*) AS n
  FROM events GROUP BY ALL),
ra AS (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], "case") - 1 AS place FROM re),
ok AS (SELECT run FROM ra GROUP BY run HAVING max(place) = count(*) - 1),
ac AS (SELECT * FROM ra SEMI JOIN ok USING (run))"""


@query("agg_19_series_summary", f"""
WITH {RESULTS}, s AS (SELECT pl.run, grp, count(*) FILTER (passed) AS score, count(passed) AS observed FROM pl LEFT JOIN ac USING (run)
  GROUP BY ALL)
SELECT grp AS "group", count(*) AS scheduled_runs, count(*) FILTER (observed = 5) AS completed_runs, min(score) AS min,
  median(score) AS median, max(score) AS max, false AS first_ten_every_run, bool_and(observed = 5 AND score = 5) AS all_passed_every_run
FROM s GROUP BY 1""")
def agg_19(t: Tables):
    return stability.series_summary(plan(t), results(t), cases(t))


@query("agg_20_case_stability", f"""
WITH {RESULTS}, sc AS (SELECT grp, count(*) AS scheduled FROM pl GROUP BY 1),
a AS (SELECT grp, "case", count(*) FILTER (passed) AS passed, count(*) AS observed FROM ac JOIN pl USING (run) GROUP BY ALL),
cs AS (SELECT DISTINCT event_type AS "case" FROM events)
SELECT sc.grp AS "group", cs."case", scheduled, coalesce(passed, 0) AS passed, coalesce(observed, 0) AS observed,
  CASE WHEN coalesce(observed, 0) < scheduled THEN 'missing' WHEN passed = scheduled THEN 'always-pass' WHEN passed = 0
  THEN 'always-fail' ELSE 'unstable' END AS status
FROM sc CROSS JOIN cs LEFT JOIN a ON a.grp = sc.grp AND a."case" = cs."case" """)
def agg_20(t: Tables):
    return stability.case_stability(plan(t), results(t), cases(t))


@query("agg_20_error_types", f"""
WITH {RESULTS}, sc AS (SELECT grp, count(*) AS scheduled FROM pl GROUP BY 1),
cs AS (SELECT DISTINCT event_type AS "case" FROM events),
o AS (SELECT grp, "case", count(*) AS observed FROM ac JOIN pl USING (run) GROUP BY ALL)
SELECT grp AS "group", "case", error_type, count(*) AS n FROM ac JOIN pl USING (run) WHERE error_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT sc.grp, cs."case", 'MISSING_RESULT', scheduled - coalesce(observed, 0) FROM sc CROSS JOIN cs
  LEFT JOIN o ON o.grp = sc.grp AND o."case" = cs."case" WHERE coalesce(observed, 0) < scheduled""")
def agg_20_errors(t: Tables):
    return stability.error_types(plan(t), results(t), cases(t))


def stages(t: Tables):
    """Two stages per run and case."""
    per = t.events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("case")).agg(
        F.count(F.lit(1)).cast("string").alias("count"), (F.max("value") > 300).cast("string").alias("high"))
    return per.select("run", "case", F.explode(F.create_map(F.lit("count"), "count", F.lit("high"), "high")).alias(
        "stage", "fingerprint"))


STAGES = """
pl AS (SELECT DISTINCT user_id AS run, CASE WHEN user_id < 60 THEN 'same' ELSE 'fresh' END AS grp FROM events),
st AS (SELECT user_id AS run, event_type AS "case", 'count' AS stage, CAST(count(*) AS VARCHAR) AS fp FROM events GROUP BY ALL
  UNION ALL SELECT user_id, event_type, 'high', CAST(max(value) > 300 AS VARCHAR) FROM events GROUP BY ALL),
rf AS (SELECT grp, min(run) AS ref FROM pl GROUP BY 1)"""


@query("agg_21_stage_variants", f"""
WITH {STAGES} SELECT grp AS "group", "case", stage, count(DISTINCT fp) AS variants FROM st JOIN pl USING (run) GROUP BY ALL""")
def agg_21(t: Tables):
    return stability.stage_variants(plan(t), stages(t))


@query("jn_23_run_comparison", f"""
WITH {STAGES} SELECT a.grp AS "group", a.run, s."case", s.stage FROM pl a JOIN rf USING (grp) JOIN st s ON s.run = a.run
JOIN st r ON r.run = rf.ref AND r."case" = s."case" AND r.stage = s.stage WHERE a.run <> rf.ref AND r.fp <> s.fp""")
def jn_23(t: Tables):
    return stability.changed_stages(plan(t), stages(t))


def calls(t: Tables):
    """Each user's events per type in time order are the calls of a case."""
    from pyspark.sql import Window as W
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("case"), (F.row_number().over(order) - 1).alias("position"),
        F.when(F.col("value") > 450, F.lit("retry")).otherwise(F.lit("read")).alias("task"),
        F.floor(F.col("value") / 100).cast("string").alias("input_hash"), F.floor(F.col("value") / 10).cast("string").alias("output_hash"),
        F.when(F.col("value") > 490, F.lit("TimeoutError")).alias("error"))


CALLS = """
ca AS (SELECT user_id AS run, event_type AS "case", row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1
  AS position, CASE WHEN value > 450 THEN 'retry' ELSE 'read' END AS task, CAST(floor(value / 100) AS BIGINT) AS i,
  CAST(floor(value / 10) AS BIGINT) AS o, CASE WHEN value > 490 THEN 'TimeoutError' END AS e FROM events)"""


@query("win_14_first_call_difference", f"""
WITH {STAGES}, {CALLS},
m AS (SELECT pl.run, pl.grp, rf.ref, c."case" FROM pl JOIN rf USING (grp) JOIN (SELECT DISTINCT run, "case" FROM ca) c ON c.run = pl.run
  SEMI JOIN ca x ON x.run = rf.ref AND x."case" = c."case" WHERE pl.run <> rf.ref),
x AS (SELECT m.grp, m.run, m."case", coalesce(w.position, g.position) AS position,
    CASE WHEN w.run IS NULL OR g.run IS NULL THEN 'call-count' WHEN w.task <> g.task THEN 'operation-order'
      WHEN w.i <> g.i THEN 'input' WHEN w.o <> g.o OR w.e IS DISTINCT FROM g.e THEN 'output-or-error' END AS kind
  FROM m JOIN (SELECT DISTINCT "case" AS c2, position AS pos FROM ca) n ON n.c2 = m."case"
  LEFT JOIN ca w ON w.run = m.ref AND w."case" = m."case" AND w.position = n.pos
  LEFT JOIN ca g ON g.run = m.run AND g."case" = m."case" AND g.position = n.pos WHERE w.run IS NOT NULL OR g.run IS NOT NULL)
SELECT grp AS "group", run, "case", min(position) AS position, arg_min(kind, position) AS kind FROM x WHERE kind IS NOT NULL GROUP BY ALL""")
def win_14(t: Tables):
    return stability.first_call_difference(plan(t), calls(t)).withColumn("position", F.col("position").cast(BIG))


@query("agg_23_repeated_inputs", f"""
WITH {STAGES}, {CALLS} SELECT grp AS "group", task, CAST(i AS VARCHAR) AS input_hash, count(*) AS observations,
  count(DISTINCT o || coalesce(e, '')) AS outcomes FROM ca JOIN pl USING (run) GROUP BY ALL HAVING count(*) > 1""")
def agg_23(t: Tables):
    return stability.repeated_inputs(plan(t), calls(t))


@query("stability_report", f"""
WITH {STAGES}, {CALLS}, r AS (SELECT grp, task, i, count(DISTINCT o || coalesce(e, '')) AS outcomes FROM ca JOIN pl USING (run)
  GROUP BY ALL HAVING count(*) > 1)
SELECT grp AS "group", count(*) AS repeated_inputs, count(*) FILTER (outcomes > 1) AS variable_inputs FROM r GROUP BY 1""")
def consistency(t: Tables):
    return stability.provider_consistency(plan(t), calls(t))


def _answers(t: Tables):
    return results(t).select("run", "case", "passed", "evidence_pass", F.sha2(F.col("n").cast("string"), 256).alias("answer_hash"),
                             F.col("error_type").alias("error"), "seconds")


@query("agg_22_stable_results", f"""
WITH {RESULTS}, c AS (SELECT "case", count(*) AS k, min(evidence_pass) = max(evidence_pass) AS same, min(n) = max(n) AS sa,
  count(error_type) AS er, bool_and(evidence_pass) AS ap FROM ra GROUP BY 1), r AS (SELECT count(DISTINCT run) AS runs FROM ra)
SELECT count(*) FILTER (same AND k = runs) AS stable_results, count(*) FILTER (sa AND k = runs AND er = 0) AS stable_answers,
  count(*) FILTER (ap AND k = runs) AS all_runs_pass, count(*) AS case_count FROM c, r""")
def agg_22(t: Tables):
    return stability.stable_results(_answers(t))


@query("benchmark_aggregate", f"""
WITH {RESULTS}, b AS (SELECT run, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (evidence_pass) AS evidence_pass,
  round(sum(seconds), 2) AS seconds FROM ra GROUP BY run)
SELECT *, (SELECT max(total) FROM b) AS expected, total = (SELECT max(total) FROM b) AS complete FROM b""")
def benchmark(t: Tables):
    return stability.benchmark_runs(_answers(t))


@query("agg_33_repeat_stability", """
WITH r AS (SELECT l_returnflag AS f, l_orderkey AS o, string_agg(l_linestatus || l_linenumber, ',' ORDER BY l_linestatus, l_linenumber) AS s
  FROM lineitem GROUP BY ALL)
SELECT o AS "case", count(*) AS repeats, count(DISTINCT s) AS variants FROM r GROUP BY o""")
def agg_33(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("case"), "l_returnflag", "l_linestatus", "l_linenumber")
    return stability.repeat_stability(rows, "case", "l_returnflag", ["l_linestatus", "l_linenumber"])


# ---- answers -----------------------------------------------------------------------------
def public_answers(t: Tables):
    """Every document answers for itself: its first line must be in its text, its source must be cited."""
    return t.documents.select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("answer"), (F.length("text") < 200).alias("insufficient"),
        F.array("source").alias("cited"), F.array(F.upper(F.get(F.split(F.translate("text", "ß", "s"), r"[ \n]"), F.lit(0)))).alias("expected"),
        F.array(F.when(F.col("lang") == "de", F.lit("src0")).otherwise(F.col("source"))).alias("expected_sources"),
        (F.col("lang") == "es").alias("allow_abstain"), F.col("text").alias("output"))


@query("score_answers", """
SELECT doc_id AS question_id, lang <> 'de' OR source = 'src0' AS sources_cited, (length(text) < 200) = (lang = 'es')
  AS abstention_correct, NOT contains(lower(text), 'clown') AND NOT contains(lower(text), '@') AS privacy_passed FROM documents""")
def score_answers(t: Tables):
    return answers.score_public(public_answers(t), ["CLOWN", "@"]).select(
        "question_id", "sources_cited", "abstention_correct", "privacy_passed")


@query("agg_37_answer_summary", """
SELECT count(*) AS total, count(*) FILTER (NOT contains(lower(text), 'clown')) AS privacy_passed FROM documents""")
def agg_37(t: Tables):
    return answers.answer_summary(answers.score_public(public_answers(t), ["clown"])).select("total", "privacy_passed")


@query("func_35_required_text", """
SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS present FROM documents""")
def func_35(t: Tables):
    return t.documents.select("doc_id", answers.contains_all(F.col("text"), F.array(F.lit("THE"), F.lit("and"))).alias("present"))


@query("func_36_forbidden_tokens", """
SELECT page_id, NOT (contains(lower(html), 'track(') OR contains(lower(html), 'example.org')) AS clean FROM pages""")
def func_36(t: Tables):
    return t.pages.select("page_id", answers.free_of(F.col("html"), ["Track(", "example.ORG"]).alias("clean"))


@query("assess_archive_answers", """
SELECT o_orderkey AS question_id, o_orderstatus <> 'P' AS coverage_complete, count(l_orderkey) FILTER (l_returnflag = 'A') AS missing_evidence
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def assess(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "A", F.concat_ws(
            "-", F.lit("Q"), "l_partkey", "l_suppkey", "l_linenumber")))), " \n ").alias("answer"),
        F.collect_list(F.struct(F.col("l_orderkey").alias("document_id"), F.concat_ws(
            "-", F.lit("q"), "l_partkey", "l_suppkey", "l_linenumber").alias("quote"))).alias("evidence"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("start "), "answer", F.lit(" end")).alias("answer"),
        F.lit(False).alias("insufficient"), F.lit(False).alias("abstain"), F.array(F.lit("START")).alias("required"), "evidence",
        F.array("o_orderkey").alias("source_ids"), (F.col("o_orderstatus") != "P").alias("complete"))
    known = t.orders.select(F.col("o_orderkey").alias("document_id"))
    return answers.assess_archive(rows, known).select("question_id", "coverage_complete", "missing_evidence")


# ---- manifests ---------------------------------------------------------------------------
@query("agg_26_table_fingerprint", """
SELECT 'documents' AS "table", count(*) AS rows, true AS order_free FROM documents UNION ALL SELECT 'orders', count(*), true FROM orders""")
def agg_26(t: Tables):
    def both(name: str):
        a = manifests.table_fingerprint(getattr(t, name))
        b = manifests.table_fingerprint(getattr(t, name).repartition(7)).withColumnRenamed("rows", "rows2")
        return a.join(b, "sha256", "left").select(F.lit(name).alias("table"), "rows", F.col("rows2").isNotNull().alias("order_free"))
    return both("documents").unionByName(both("orders"))


@query("agg_34_dataset_fingerprint", """
WITH h AS (SELECT url AS path, sha256(html) AS sha256 FROM pages),
r AS (SELECT sha256('{"path":"' || path || '","sha256":"' || sha256 || '"}') AS h, count(*) AS n FROM h GROUP BY path, sha256),
a AS (SELECT substr(h, 1, 7) AS k, sum(n) AS n, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS h FROM r GROUP BY 1),
b AS (SELECT substr(k, 1, 5) AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS h FROM a GROUP BY 1),
c AS (SELECT substr(k, 1, 3) AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS h FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS sha256 FROM c""")
def agg_34(t: Tables):
    return manifests.file_set_fingerprint(t.pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256")))


@query("agg_35_vector_fingerprint", """
WITH r AS (SELECT sha256('{"vec_id":' || vec_id || ',"millionths":[' || array_to_string(list_transform(embedding,
  lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000.0) AS BIGINT)), ',') || ']}') AS h, 1 AS n FROM embeddings),
a AS (SELECT substr(h, 1, 7) AS k, sum(n) AS n, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS h FROM r GROUP BY 1),
b AS (SELECT substr(k, 1, 5) AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS h FROM a GROUP BY 1),
c AS (SELECT substr(k, 1, 3) AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS h FROM b GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS sha256 FROM c""")
def agg_35(t: Tables):
    # Components in millionths: the digits of a float's text differ between engines.
    whole = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000000.0).cast("bigint"))
    return manifests.table_fingerprint(t.embeddings.select("vec_id", whole.alias("millionths")))


def _files(t: Tables):
    stored = t.pages.select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("sha256"), "html")
    want = stored.filter(~F.col("html").contains('lang="de"')).drop("html")
    have = stored.filter(~F.col("html").contains('lang="fr"')).select("path", F.when(
        F.col("html").contains('lang="es"'), F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return want, have


FILES = """f AS (SELECT CAST(page_id AS VARCHAR) AS path, html LIKE '%lang="de"%' AS de, html LIKE '%lang="fr"%' AS fr,
  html LIKE '%lang="es"%' AS es FROM pages)"""


@query("jn_14_manifest_comparison", f"""
WITH {FILES} SELECT path, CASE WHEN fr THEN 'missing' WHEN de THEN 'unexpected' ELSE 'changed' END AS problem FROM f
WHERE (fr AND NOT de) OR (de AND NOT fr) OR (es AND NOT de AND NOT fr)""")
def jn_14(t: Tables):
    return manifests.compare_files(*_files(t))


def _table_rows(t: Tables, changed: bool):
    frames = []
    for name in TABLES:
        df = getattr(t, name)
        if changed and name == "events":
            df = df.filter("event_type <> 'view'")
        if changed and name == "nation":
            df = df.withColumn("n_name", F.lower("n_name"))
        if not (changed and name == "labels"):
            frames.append(manifests.table_fingerprint(df).withColumn("table", F.lit(name)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("jn_15_table_comparison", """
SELECT 'events' AS "table", 'row-count' AS problem UNION ALL SELECT 'nation', 'content' UNION ALL SELECT 'labels', 'missing'""")
def jn_15(t: Tables):
    return manifests.compare_tables(_table_rows(t, False), _table_rows(t, True))


@query("jn_16_reference_check", f"""
WITH {FILES} SELECT path, CASE WHEN fr THEN 'missing' ELSE 'sha256-mismatch' END AS problem FROM f
WHERE NOT de AND (fr OR es) AND NOT (es AND length(path) = 1)""")
def jn_16(t: Tables):
    want, have = _files(t)
    known = manifests.reference_issues(want, have).filter("problem = 'sha256-mismatch' AND length(path) = 1")
    return manifests.new_reference_issues(want, have, known)


@query("verify_restore", f"""
WITH {FILES} SELECT 'file' AS part, path AS name, CASE WHEN fr THEN 'missing' WHEN de THEN 'unexpected' ELSE 'changed' END AS problem
FROM f WHERE fr OR de OR es
UNION ALL SELECT 'reference', path, CASE WHEN fr THEN 'missing' ELSE 'sha256-mismatch' END FROM f WHERE NOT de AND (fr OR es)
UNION ALL SELECT 'table', 'orders', 'content'""")
def verify_restore(t: Tables):
    want, have = _files(t)
    first = manifests.table_fingerprint(t.orders).withColumn("table", F.lit("orders"))
    other = manifests.table_fingerprint(t.orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)).withColumn(
        "table", F.lit("orders"))
    none = want.select("path", F.lit("x").alias("problem")).filter("false")
    return manifests.verify_restore((first, other), (want, have), want, none)


@query("agg_27_backup_totals", """
SELECT 2::BIGINT AS tables, (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) AS rows, count(*) AS files,
  (SELECT count(*) FROM documents) AS documents FROM pages""")
def agg_27(t: Tables):
    tables = manifests.table_fingerprint(t.documents).withColumn("table", F.lit("documents")).unionByName(
        manifests.table_fingerprint(t.orders).withColumn("table", F.lit("orders")))
    return manifests.backup_summary(tables, t.pages.select(F.col("url").alias("path")))


@query("set_8_identity_completeness", f"""
WITH {RESULTS} SELECT count(DISTINCT run) AS runs, count(DISTINCT run) FILTER (run IN (SELECT run FROM ok)) AS accepted FROM ra""")
def set_8(t: Tables):
    r = results(t)
    kept = stability.accepted_results(r, cases(t)).select("run").distinct().withColumn("ok", F.lit(1))
    return r.select("run").distinct().join(kept, "run", "left").agg(F.count(F.lit(1)).alias("runs"),
                                                                    F.count("ok").alias("accepted"))
