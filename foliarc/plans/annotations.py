"""Laboratory, statement and proposal operators over texts built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliarc.operators import catalogue as cat
from foliarc.operators import lab, proposals, statements
from foliarc.plans.registry import Tables, query
from foliarc.session import durable

BIG = "bigint"


def _line():
    quantity = F.regexp_replace(F.col("l_quantity").cast("string"), r"\.", ",")
    result = (F.when(F.col("l_discount") >= 0.09, F.lit("n/a"))
              .when(F.col("l_returnflag") == "N", F.concat(F.lit("<"), quantity))
              .when(F.col("l_returnflag") == "A", quantity).otherwise(F.lit("Positive")))
    return F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" | "), result, F.lit(" | "),
                    F.when(F.col("l_tax") < 0.04, F.lit("mg/L")).otherwise(F.lit("")), F.lit(" | 0-"),
                    F.col("l_suppkey"))


def reports(t: Tables):
    """A laboratory report per order, one table row per line item."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", _line().alias("line")))),
        lambda r: r["line"]), "\n").alias("body"))
    date = F.when(F.col("o_orderstatus") == "P", F.lit("02.1997")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    second = F.when(F.col("o_orderstatus") == "O", F.lit("Result date: 11.11.2011\n")).otherwise(F.lit(""))
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Subject: patient\n")).otherwise(F.lit(""))
    text = F.concat(F.lit("Laboratory report\nResult date: "), date, F.lit("\n"), second, subject,
                    F.lit("Test | Result | Unit | Reference\n"), F.col("body"), F.lit("\n\nFree remark"))
    joined = rows.join(t.orders, F.col("document_id") == F.col("o_orderkey"))
    return joined.select("document_id", F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"))).alias("pages"))


LAB = """
li AS (SELECT *, replace(CAST(l_quantity AS VARCHAR), '.', ',') AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ln AS (SELECT *, CASE WHEN l_discount >= 0.09 THEN 'n/a' WHEN l_returnflag = 'N' THEN '<' || q WHEN l_returnflag = 'A' THEN q
    ELSE 'Positive' END AS raw, CASE WHEN l_tax < 0.04 THEN 'mg/L' END AS unit,
  strlen('Laboratory report' || chr(10) || 'Result date: ' || CASE WHEN o_orderstatus = 'P' THEN '02.1997' ELSE '1997-01-01' END
    || chr(10) || CASE WHEN o_orderstatus = 'O' THEN 'Result date: 11.11.2011' || chr(10) ELSE '' END
    || CASE WHEN o_orderpriority = '1-URGENT' THEN 'Subject: patient' || chr(10) ELSE '' END
    || 'Test | Result | Unit | Reference' || chr(10)) AS head FROM li),
t0 AS (SELECT *, 'Part ' || l_partkey || ' | ' || raw || ' | ' || coalesce(unit, '') || ' | 0-' || l_suppkey AS line FROM ln),
tx AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, line) AS n FROM t0),
ps AS (SELECT *, head + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM tx),
lab AS (SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS row_index,
  'Part ' || l_partkey AS name, raw, CASE WHEN l_returnflag = 'N' THEN '<' WHEN l_returnflag = 'A' THEN '=' END AS comparator,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS VARCHAR) END AS numeric_value, unit, '0-' || l_suppkey AS reference,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'PATIENT' ELSE 'UNKNOWN' END AS subject,
  CAST(pos AS BIGINT) AS start_byte, CAST(pos + strlen(line) AS BIGINT) AS end_byte, line, o_orderstatus, o_orderdate,
  l_quantity, l_returnflag FROM ps WHERE l_discount < 0.09)"""


@query("annotate_lab_rows", f"""
WITH {LAB} SELECT document_id, row_index, name, raw, comparator, numeric_value, unit, reference, subject, start_byte,
  end_byte, line AS source_text FROM lab""")
def lab_rows(t: Tables):
    return lab.lab_rows(lab.annotated_lines(reports(t))).select(
        "document_id", F.col("row_index").cast(BIG).alias("row_index"), "name", "raw", "comparator", "numeric_value",
        "unit", "reference", "subject", F.col("start_byte").cast(BIG).alias("start_byte"),
        F.col("end_byte").cast(BIG).alias("end_byte"), "source_text")


@query("project_lab_facts", f"""
WITH {LAB} SELECT document_id, row_index, name, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS value_number, unit,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS event_date FROM lab""")
def lab_facts(t: Tables):
    facts = lab.project_lab_facts(lab.dated_rows(lab.annotated_lines(reports(t))))
    return facts.select("document_id", F.col("row_index").cast(BIG).alias("row_index"), "name", "value_number", "unit",
                        F.col("event_date").cast("string").alias("event_date"))


@query("agg_32_issue_counts", f"""
WITH li AS (SELECT l_orderkey AS document_id, count(*) FILTER (l_discount >= 0.09) AS bad FROM lineitem GROUP BY 1),
i AS (SELECT document_id, 'UNSUPPORTED_ROW' AS code, bad AS n FROM li WHERE bad > 0
  UNION ALL SELECT document_id, 'UNSUPPORTED_CONTENT', 1 FROM li
  UNION ALL SELECT document_id, 'INVALID_DATE', 1 FROM li JOIN orders ON o_orderkey = document_id WHERE o_orderstatus = 'P'
  UNION ALL SELECT document_id, 'DATE_CONFLICT', 1 FROM li JOIN orders ON o_orderkey = document_id
    WHERE o_orderstatus = 'O' AND o_orderdate::DATE <> DATE '2011-11-11')
SELECT document_id, code, CAST(n AS BIGINT) AS issues FROM i""")
def issue_counts(t: Tables):
    lines = durable(lab.annotated_lines(reports(t)).filter("kind NOT IN ('ROW', 'SUBJECT')").select(
        "document_id", "kind", "role", "date", "page_index", "start_byte", "end_byte"))
    return lab.lab_issues(lines).groupBy("document_id", "code").agg(
        F.count(F.lit(1)).alias("issues"))


@query("win_8_line_state", f"""
WITH {LAB} SELECT l_orderkey AS document_id, count(*) AS candidate_rows,
  count(*) FILTER (l_discount < 0.09) AS accepted_rows FROM ps GROUP BY 1""")
def line_state(t: Tables):
    return lab.lab_summary(lab.annotated_lines(reports(t))).select("document_id", "candidate_rows", "accepted_rows")


@query("validate_lab", f"""
WITH {LAB} SELECT document_id, row_index, 'NAME' AS code FROM lab WHERE reference = '0-7'
UNION ALL SELECT document_id, row_index, 'PROJECTION' FROM lab WHERE reference = '0-7'""")
def validate_lab(t: Tables):
    """Stored rows of supplier 7 carry a wrong name, which the stored facts do not share."""
    docs = durable(reports(t))
    lines = durable(lab.dated(lab.annotated_lines(docs)))
    rows, dates, issues = lab.lab_rows(lines, "event_date"), lab.lab_dates(lines), lab.lab_issues(lines)
    facts = lab.project_lab_facts(rows)
    wrong = rows.withColumn("name", F.when(F.col("reference") == "0-7", F.lit("Other test")).otherwise(F.col("name")))
    return lab.validate_lab(wrong, dates, lab.lab_subjects(lines), issues, facts, docs).select(
        "document_id", F.col("row_index").cast(BIG).alias("row_index"), "code")


def _readers(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
        F.col("l_partkey").cast("string").alias("test"), F.col("l_quantity").cast("string").alias("result"),
        F.col("l_returnflag").alias("unit"), F.col("l_suppkey").cast("string").alias("reference"), "l_tax", "l_discount")
    from pyspark.sql import Window as W
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("document_id").orderBy("k")))
    def channel(name: str, test, result):
        return F.struct(F.lit(name).alias("channel"), test.alias("test"), result.alias("result"))

    test, result = F.col("test"), F.col("result")
    # All channels come from one numbered pass, and stay where their document is.
    seen = F.array_compact(F.array(
        channel("text_layer", test, result), F.when(F.col("l_tax") < 0.08, channel("ocr", F.concat(F.lit("  "), test), result)),
        channel("vision", test, F.when(F.col("l_discount") > 0.08, F.lit("?")).otherwise(result))))
    return rows.select("document_id", "row", "unit", "reference", F.explode(seen).alias("c")).select(
        "document_id", "row", "c.test", "c.result", "unit", "reference", "c.channel")


@query("reconcile_readers", """
WITH c AS (SELECT l_orderkey AS document_id, count(*) AS n, count(*) FILTER (l_tax < 0.08) AS ocr,
  count(*) FILTER (l_discount > 0.08) AS odd FROM lineitem GROUP BY 1)
SELECT document_id, CASE WHEN ocr > 0 AND ocr <> n THEN 'REVIEW_ALIGNMENT' WHEN odd > 0 THEN 'REVIEW_CONFLICT'
  WHEN ocr > 0 AND o_orderstatus = 'F' THEN 'CONSISTENT_3' ELSE 'REVIEW_INSUFFICIENT' END AS decision,
  CAST(CASE WHEN ocr > 0 AND ocr <> n THEN 1 ELSE odd END AS BIGINT) AS issues
FROM c JOIN orders ON o_orderkey = document_id""")
def reconcile(t: Tables):
    origins = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(
        F.col("o_orderstatus") == "F", F.lit("NATIVE")).otherwise(F.lit("OCR_DERIVED")).alias("text_layer_origin"))
    return lab.reconcile_readers(_readers(t), origins)[0].select("document_id", "decision", "issues")


@query("jn_13_row_alignment", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber || '-' || l_partkey || '-' || l_suppkey)
  AS row, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (l_tax < 0.08) OVER (PARTITION BY l_orderkey) AS ocr
  FROM lineitem)
SELECT l_orderkey AS document_id, row, 'result' AS field FROM r WHERE l_discount > 0.08 AND (ocr = 0 OR ocr = n)
UNION ALL SELECT DISTINCT l_orderkey, CAST(NULL AS BIGINT), 'row_count' FROM r WHERE ocr > 0 AND ocr <> n""")
def alignment(t: Tables):
    origins = t.orders.select(F.col("o_orderkey").alias("document_id"), F.lit("NATIVE").alias("text_layer_origin"))
    return lab.reconcile_readers(_readers(t), origins)[1]


def _audit(t: Tables):
    rows = _readers(t)
    expected = rows.filter("channel = 'text_layer'").drop("channel")
    seen = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_id"))
    observed = rows.filter("channel = 'vision'").drop("channel").join(seen, "document_id", "left_semi")
    return lab.audit_table_reader(expected, observed, ["document_id"])


@query("audit_table_reader", """
WITH c AS (SELECT l_orderkey AS document_id, count(*) AS n, count(*) FILTER (l_discount > 0.08) AS odd FROM lineitem GROUP BY 1)
SELECT document_id, CASE WHEN o_orderstatus = 'P' THEN 'ERROR' WHEN odd > 0 THEN 'REVIEW' ELSE 'PASS' END AS status,
  n AS expected_rows, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE odd END AS mismatches
FROM c JOIN orders ON o_orderkey = document_id""")
def audit_reader(t: Tables):
    return _audit(t)[0].select("document_id", "status", "expected_rows", "mismatches")


@query("agg_36_table_audit_totals", """
WITH c AS (SELECT l_orderkey AS document_id, count(*) AS n, count(*) FILTER (l_discount > 0.08) AS odd FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS expected_rows, count(*) FILTER (o_orderstatus <> 'P' AND odd = 0) AS passed,
  count(*) FILTER (o_orderstatus <> 'P' AND odd > 0) AS review, count(*) FILTER (o_orderstatus = 'P') AS error
FROM c JOIN orders ON o_orderkey = document_id""")
def audit_totals(t: Tables):
    return lab.audit_totals(_audit(t)[0])


# ---- statements --------------------------------------------------------------------------
def turn_blocks(t: Tables):
    """Conversations as documents: every turn is a paragraph block."""
    return t.conversations.select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("block_order"),
        F.concat(F.lit("p0:b"), F.col("turn")).alias("block_id"), F.lit("paragraph").alias("kind"),
        F.lit(0).alias("page_index"), F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte"), "text")


def candidates(t: Tables):
    """One candidate per turn: its first sentence, named by the first word in upper case."""
    sentence = F.regexp_extract("text", r"^([^.]*\.)", 1)
    user = F.col("role") == "user"
    word = F.regexp_extract(sentence, r"^([\p{L}]+)", 1)
    return t.conversations.select(
        F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("ord"),
        F.concat(F.lit("p0:b"), F.col("turn")).alias("block_id"),
        F.when(word.contains("ß"), word).otherwise(F.upper(word)).alias("name"),
        F.when(user, F.lit("MEDICATION")).otherwise(F.lit("CONDITION")).alias("kind"),
        F.when(F.col("turn") > 3, F.lit("FAMILY")).otherwise(F.lit("PATIENT")).alias("subject"),
        F.when(user, F.lit("UNKNOWN")).otherwise(F.lit("SUSPECTED")).alias("assertion"),
        F.when(user & (F.col("turn") == 0), F.lit("TAKING")).when(user, F.lit("PRESCRIBED"))
        .otherwise(F.lit("NOT_APPLICABLE")).alias("medication_state"),
        F.lit("CURRENT").alias("temporality"), sentence.alias("source_text"))


CAND = """
c AS (SELECT conv_id AS document_id, turn, role, text, regexp_extract(text, '^([^.]*\\.)', 1) AS s,
  regexp_extract(regexp_extract(text, '^([^.]*\\.)', 1), '^([\\p{L}]+)', 1) AS w FROM conversations),
k AS (SELECT *, length(s) > 0 AND length(w) > 0 AND length(w) <= 200 AND length(s) <= 3000
  AND (length(text) - length(replace(text, s, ''))) / length(s) = 1
  AND (contains(w, 'ß') OR contains(s, upper(w)) OR len(regexp_extract_all(lower(s), lower(w))) = 1) AS ok FROM c)"""


@query("bind_statements", f"""
WITH {CAND} SELECT document_id, turn AS ord, CASE WHEN contains(s, upper(w)) THEN upper(w) ELSE w END AS name,
  strlen(s) AS end_byte, CAST(row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS BIGINT) AS statement_index
FROM k WHERE ok""")
def bind(t: Tables):
    kept, _ = statements.bind_statements(candidates(t), statements.plan_blocks(turn_blocks(t)))
    return kept.select("document_id", F.regexp_extract("block_id", r"(\d+)$", 1).cast(BIG).alias("ord"), "name",
                       F.col("end_byte").cast(BIG).alias("end_byte"),
                       F.col("statement_index").cast(BIG).alias("statement_index"))


@query("bind_statement_issues", f"""
WITH {CAND} SELECT document_id, 'REJECTED_CANDIDATE' AS code, count(*) AS issues FROM k WHERE NOT ok GROUP BY 1""")
def bind_issues(t: Tables):
    _, issues = statements.bind_statements(candidates(t), statements.plan_blocks(turn_blocks(t)))
    return issues.groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("issues"))


STATUS = """CASE WHEN turn > 3 THEN 'UNKNOWN' WHEN role = 'user' THEN CASE WHEN turn = 0 THEN 'CONFIRMED' ELSE 'PRESCRIBED' END
  ELSE 'SUSPECTED' END"""


@query("project_statements", f"""
WITH {CAND} SELECT document_id, turn AS ord, CASE WHEN turn > 3 THEN 'OBSERVATION' WHEN role = 'user' THEN 'MEDICATION'
  ELSE 'CONDITION' END AS type, {STATUS} AS assertion_status, sha256(text) AS text_hash FROM k WHERE ok""")
def project(t: Tables):
    kept, _ = statements.bind_statements(candidates(t), statements.plan_blocks(turn_blocks(t)))
    order = kept.select("document_id", "statement_index", F.regexp_extract("block_id", r"(\d+)$", 1).cast(BIG).alias("ord"))
    return statements.project_statements(kept).join(order, ["document_id", "statement_index"]).select(
        "document_id", "ord", "type", "assertion_status", F.sha2("source_text", 256).alias("text_hash"))


@query("func_31_projected_status", f"""
WITH c AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, turn, {STATUS} AS status FROM c""")
def projected(t: Tables):
    return candidates(t).select(F.col("document_id").alias("conv_id"), F.col("ord").cast(BIG).alias("turn"),
                                statements.projected_status().alias("status"))


@query("jn_20_block_lookup", """
SELECT conv_id AS document_id, turn AS ord, length(text) <= 400 AS eligible FROM conversations""")
def block_lookup(t: Tables):
    planned = statements.plan_blocks(turn_blocks(t), block_chars=400)
    return candidates(t).join(planned.select("document_id", "block_id", "eligible"), ["document_id", "block_id"]).select(
        "document_id", F.col("ord").cast(BIG).alias("ord"), "eligible")


@query("win_15_review_batches", f"""
WITH {CAND}, s AS (SELECT document_id, turn, row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS i FROM k WHERE ok)
SELECT document_id, turn AS ord, 0::BIGINT AS review_batch FROM s""")
def review_batches(t: Tables):
    kept, _ = statements.bind_statements(candidates(t), statements.plan_blocks(turn_blocks(t)))
    return statements.review_batches(kept).select(
        "document_id", F.regexp_extract("block_id", r"(\d+)$", 1).cast(BIG).alias("ord"),
        F.col("review_batch").cast(BIG).alias("review_batch"))


def second_reading(t: Tables, kept):
    """Second opinions: assistants' statements differ, late turns find nothing, turn 1 is unanswered."""
    turn = F.regexp_extract("block_id", r"(\d+)$", 1).cast("int")
    fields = F.struct(
        F.col("block_id"), F.col("name"), F.col("kind"), F.col("subject"),
        F.when(F.col("kind") == "CONDITION", F.lit("NEGATED")).otherwise(F.col("assertion")).alias("assertion"),
        F.col("medication_state"), F.col("temporality"), F.col("source_text"))
    return kept.filter(turn != 1).select("document_id", "statement_index",
                                         F.when(turn < 5, fields).alias("interpretation"))


VERDICT = """CASE WHEN turn = 1 THEN 'INVALID_RESPONSE' WHEN turn >= 5 THEN 'INSUFFICIENT_EVIDENCE'
  WHEN role = 'user' THEN 'MATCH' ELSE 'SEMANTIC_DISAGREEMENT' END"""


@query("review_statements", f"""
WITH {CAND} SELECT document_id, turn AS ord, {VERDICT} AS reason FROM k WHERE ok""")
def review(t: Tables):
    planned = statements.plan_blocks(turn_blocks(t))
    kept, _ = statements.bind_statements(candidates(t), planned)
    checks = statements.review_statements(kept, second_reading(t, kept), planned)
    order = kept.select("document_id", "statement_index", F.regexp_extract("block_id", r"(\d+)$", 1).cast(BIG).alias("ord"))
    return checks.join(order, ["document_id", "statement_index"]).select("document_id", "ord", "reason")


@query("validate_statements", f"""
WITH {CAND} SELECT document_id, turn AS ord, 'PROJECTION' AS code FROM k WHERE ok AND turn = 2""")
def validate(t: Tables):
    planned = statements.plan_blocks(turn_blocks(t))
    kept, _ = statements.bind_statements(candidates(t), planned)
    docs = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(F.lit(1).alias("one"))
    turn = F.regexp_extract("block_id", r"(\d+)$", 1).cast(BIG)
    order = kept.select("document_id", "statement_index", turn.alias("ord"), F.col("context_text").alias("page_text"))
    facts = statements.project_statements(kept).join(order, ["document_id", "statement_index"]).withColumn(
        "name", F.when(F.col("ord") == 2, F.lit("other")).otherwise(F.col("name")))
    # Every turn is its own page here, so the page list is looked up through the block's order.
    pages = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text"))),
        lambda p: F.struct(p["turn"].cast("int").alias("page_number"), p["text"].alias("text"))).alias("pages"))
    paged = kept.withColumn("page_index", turn.cast("int"))
    return statements.validate_statements(paged, planned, pages.join(docs, "document_id"), facts).join(
        order, ["document_id", "statement_index"]).select("document_id", "ord", "code")


# ---- proposals ---------------------------------------------------------------------------
def proposals_of(t: Tables):
    """One proposal per turn quoting the whole turn; user turns past the second claim a wrong page."""
    wrong = (F.col("role") == "user") & (F.col("turn") > 2)
    return t.conversations.select(
        F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 8).cast("int").alias("batch"),
        F.col("turn").cast("int").alias("ord"), F.lit("OBSERVATION").alias("type"), F.col("role").alias("name"),
        (F.col("turn") + F.when(wrong, 1001).otherwise(1)).cast("int").alias("page"),
        F.regexp_replace("text", " ", "\n ").alias("source_text"), F.lit(None).cast("string").alias("value_text"),
        F.lit(None).cast("double").alias("value_number"), F.lit("mg").alias("unit"),
        F.lit("2024-02-30").alias("event_date"), F.lit("UNKNOWN").alias("assertion_status"),
        (F.col("turn") / 4).alias("confidence"))


def proposal_pages(t: Tables):
    return t.conversations.select(F.col("conv_id").alias("document_id"),
                                  (F.col("turn") + 1).cast("int").alias("page_number"), "text")


@query("verify_fact_proposals", """
SELECT conv_id AS document_id, turn AS ord FROM conversations WHERE NOT (role = 'user' AND turn > 2)""")
def verify_proposals(t: Tables):
    accepted, _ = proposals.verify_fact_proposals(proposals_of(t), proposal_pages(t))
    return accepted.select("document_id", F.col("ord").cast(BIG).alias("ord"))


@query("proposal_warnings", """
SELECT conv_id AS document_id, 'QUOTE_REJECTED' AS code, count(*) AS facts FROM conversations
WHERE role = 'user' AND turn > 2 GROUP BY conv_id
UNION ALL SELECT conv_id, 'FACT_LIMIT', count(*) FROM conversations GROUP BY conv_id, turn // 8 HAVING count(*) >= 8""")
def proposal_warnings(t: Tables):
    _, warnings = proposals.verify_fact_proposals(proposals_of(t), proposal_pages(t))
    return warnings.select("document_id", "code", "facts")


@query("fil_9_extraction_validity", """
SELECT conv_id AS document_id, turn AS ord, 'EVENT_DATE' AS code FROM conversations
UNION ALL SELECT conv_id, turn, 'CONFIDENCE' FROM conversations WHERE turn > 4
UNION ALL SELECT conv_id, turn, 'PAGE' FROM conversations WHERE role = 'user' AND turn > 2""")
def validity(t: Tables):
    texts = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    return proposals.validate_extraction(proposals_of(t), proposal_pages(t), texts).select(
        "document_id", F.col("ord").cast(BIG).alias("ord"), "code")


@query("win_6_keep_first", """
SELECT min(doc_id) AS doc_id, source, count(*) AS copies FROM documents GROUP BY source, text""")
def keep_first(t: Tables):
    return cat.keep_first(t.documents.select("doc_id", "source", "text"), ["source", "text"], ["doc_id"]).select("doc_id", "source", "copies")


@query("win_7_row_cap", """
SELECT user_id, CAST(least(count(*), 50) AS BIGINT) AS kept, CAST(greatest(count(*) - 50, 0) AS BIGINT) AS overflow
FROM events GROUP BY user_id""")
def row_cap(t: Tables):
    rows, over = cat.capped(t.events, ["user_id"], ["ts", "event_id"], 50)
    kept = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(over, "user_id", "left").select("user_id", "kept", F.coalesce("overflow", F.lit(0)).cast("bigint").alias("overflow"))


@query("extraction_batches", """
WITH s AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id AS document_id, count(*) AS parts, CAST(sum(n) AS BIGINT) AS chars FROM s WHERE n > 0 GROUP BY 1""")
def extraction(t: Tables):
    parts = proposals.extraction_batches(proposal_pages(t))
    return parts.groupBy("document_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("chars"))


@query("reconcile_batches", """
SELECT conv_id AS document_id, CASE WHEN max(turn) < 2 THEN '2024-01-01' END AS document_date, max(turn) >= 2 AS date_conflict,
  string_agg(DISTINCT role, ',' ORDER BY role) AS tags FROM conversations GROUP BY conv_id""")
def reconcile_batches(t: Tables):
    batches = t.conversations.select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("batch"),
        F.when(F.col("turn") < 2, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("document_date"),
        F.col("role").alias("summary"), F.array("role", "role").alias("tags"))
    done = proposals.reconcile_batches(batches)
    return done.select("document_id", F.col("document_date").cast("string").alias("document_date"), "date_conflict",
                       F.array_join(F.sort_array("tags"), ",").alias("tags"))
