"""Archive tables derived from the test tables: orders are documents, line items are facts,
events are jobs, runs and audit entries. ``SQL`` holds the same derivations for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.plans.registry import Tables

TYPE_OF = {"1-URGENT": "LAB_REPORT", "2-HIGH": "VISIT", "3-MEDIUM": "NOTE", "4-NOT SPECIFIED": "PRESCRIPTION"}


def docs(t: Tables) -> DataFrame:
    o = t.orders
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    kind = F.lit("OTHER")
    for code, name in TYPE_OF.items():
        kind = F.when(priority == code, F.lit(name)).otherwise(kind)
    key = F.col("o_orderkey").cast("string")
    title = F.concat(F.lit("Order "), key, F.lit(" "), priority)
    summary = F.when(price < 100000, F.lit("")).otherwise(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("READY"))
              .when(F.col("o_orderstatus") == "P", F.lit("FAILED"))
              .when(price > 250000, F.lit("INDEXING")).otherwise(F.lit("UPLOADED")))
    return o.select(
        F.col("o_orderkey").alias("document_id"), title.alias("title"), kind.alias("document_type"),
        F.when(price >= 50000, F.to_date("o_orderdate")).alias("document_date"), status.alias("status"),
        F.when(price > 450000, F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderdate").alias("created_at"),
        summary.alias("summary"),
        F.array(F.lower(priority), F.col("o_orderstatus"),
                F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"))).alias("tags"),
        F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")), 256)
        .alias("sha256"),
        F.substring(priority, 1, 1).cast("int").alias("text_version"),
        (F.month("o_orderdate") + 1).alias("generation"),
        F.when(F.col("o_orderstatus") == "P", F.lit("PDF")).otherwise(F.lit("TEXT")).alias("source_type"),
        F.when(price > 100000, F.concat(F.lit("rev-"), key)).alias("active_revision_id"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("/data/"), key, F.lit(".pdf"))).alias("storage_path"),
        F.concat_ws("\n", title, summary).alias("search_text"), price.alias("price"))


def texts(t: Tables) -> DataFrame:
    """Every stored text version of every document."""
    return docs(t).select("document_id", F.explode(F.sequence(F.lit(1), F.col("text_version"))).alias("version")).select(
        "document_id", "version",
        F.concat(F.lit("text-"), F.col("document_id").cast("string"), F.lit("-"), F.col("version").cast("string"))
        .alias("text_revision_id"),
        F.concat(F.lit("Order "), F.col("document_id").cast("string"), F.lit(" text "),
                 F.col("version").cast("string")).alias("content"))


def revisions(t: Tables) -> DataFrame:
    """Active processing revisions; the cheaper half was built from the current text."""
    d = docs(t).filter(F.col("active_revision_id").isNotNull())
    built = F.when(F.col("price") < 300000, F.col("text_version")).otherwise(
        F.greatest(F.lit(1), F.col("text_version") - 1))
    return d.select(
        "document_id", F.col("active_revision_id").alias("revision_id"), F.lit("ACTIVE").alias("status"),
        F.concat(F.lit("text-"), F.col("document_id").cast("string"), F.lit("-"), built.cast("string"))
        .alias("text_revision_id"), "created_at",
        F.concat(F.lit("run-"), F.col("document_id").cast("string")).alias("run_id"))


def facts(t: Tables) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    review = (F.when(F.col("l_linenumber") == 2, F.lit("CONFIRMED")).when(F.col("l_linenumber") == 3, F.lit("CORRECTED"))
              .when(F.col("l_linenumber") == 4, F.lit("REJECTED")).otherwise(F.lit("UNREVIEWED")))
    kind = (F.when(F.col("l_returnflag") == "N", F.lit("LAB_RESULT"))
            .when(F.col("l_returnflag") == "A", F.lit("MEDICATION")).otherwise(F.lit("CONDITION")))
    status = F.when(F.col("l_linestatus") == "O", F.lit("CONFIRMED")).otherwise(F.lit("UNKNOWN"))
    number = F.when(F.col("l_discount") >= 0.05, F.col("l_quantity"))
    text = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string")))
    unit = F.when(F.col("l_tax") < 0.04, F.lit("mg"))
    day = F.to_date("l_shipdate")
    corrected = review == "CORRECTED"
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"),
        F.col("l_orderkey").alias("document_id"), kind.alias("type"), F.concat(F.lit("part "), part).alias("name"),
        text.alias("value_text"), number.alias("value_number"), unit.alias("unit"), day.alias("event_date"),
        status.alias("assertion_status"), review.alias("review_status"), (F.col("l_tax") < 0.07).alias("active"),
        F.struct(
            kind.alias("type"),
            F.when(corrected, F.concat(F.lit("Original  Part "), part)).otherwise(F.concat(F.lit("part "), part))
            .alias("name"),
            text.alias("value_text"), F.when(corrected, number + 1).otherwise(number).alias("value_number"),
            unit.alias("unit"), day.alias("event_date"), status.alias("assertion_status")).alias("original"),
        F.col("l_shipdate").alias("created_at"))


def jobs(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"),
        F.when(F.col("event_type") == "error", F.lit("REMOVE"))
        .when(F.col("event_type").isin("click", "purchase"), F.lit("PROCESS")).otherwise(F.lit("INDEX"))
        .alias("operation"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).when(F.col("event_type") == "view", F.lit("QUEUED"))
        .otherwise(F.lit("READY")).alias("status"),
        F.ceil(F.col("value") / 100).cast("int").alias("generation"), F.col("ts").alias("created_at"))


def runs(t: Tables) -> DataFrame:
    """One run per priced document; dearer documents failed to extract."""
    return docs(t).select(
        F.concat(F.lit("run-"), F.col("document_id").cast("string")).alias("run_id"), "document_id",
        F.when(F.col("price") < 200000, F.lit("READY")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(F.col("price") < 150000, F.col("text_version")).otherwise(
            F.greatest(F.lit(1), F.col("text_version") - 1)).alias("text_version"), "created_at")


def audit(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("document_id"),
                           F.col("event_type").alias("action"), F.col("props").alias("payload"),
                           F.col("ts").alias("created_at"))


SQL = {
    "docs": """docs AS (SELECT o_orderkey AS document_id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'LAB_REPORT' WHEN '2-HIGH' THEN 'VISIT' WHEN '3-MEDIUM' THEN 'NOTE'
    WHEN '4-NOT SPECIFIED' THEN 'PRESCRIPTION' ELSE 'OTHER' END AS document_type,
  CASE WHEN o_totalprice >= 50000 THEN o_orderdate::DATE END AS document_date,
  CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'FAILED'
    ELSE CASE WHEN o_totalprice > 250000 THEN 'INDEXING' ELSE 'UPLOADED' END END AS status,
  CASE WHEN o_totalprice > 450000 THEN o_orderdate END AS deleted_at, o_orderdate AS created_at,
  CASE WHEN o_totalprice < 100000 THEN '' ELSE 'Customer ' || o_custkey END AS summary,
  [lower(o_orderpriority), o_orderstatus, 'customer-' || o_custkey] AS tags,
  sha256(o_custkey || ':' || strftime(o_orderdate, '%Y-%m')) AS sha256,
  substr(o_orderpriority, 1, 1)::INT AS text_version, (month(o_orderdate) + 1)::INT AS generation,
  CASE WHEN o_orderstatus = 'P' THEN 'PDF' ELSE 'TEXT' END AS source_type,
  CASE WHEN o_totalprice > 100000 THEN 'rev-' || o_orderkey END AS active_revision_id,
  CASE WHEN o_orderstatus = 'P' THEN '/data/' || o_orderkey || '.pdf' END AS storage_path,
  'Order ' || o_orderkey || ' ' || o_orderpriority || chr(10) ||
    CASE WHEN o_totalprice < 100000 THEN '' ELSE 'Customer ' || o_custkey END AS search_text,
  o_totalprice AS price FROM orders)""",
    "texts": """texts AS (SELECT document_id, version::INT AS version, 'text-' || document_id || '-' || version AS text_revision_id,
  'Order ' || document_id || ' text ' || version AS content
  FROM (SELECT document_id, unnest(generate_series(1, text_version)) AS version FROM docs))""",
    "revisions": """revisions AS (SELECT document_id, active_revision_id AS revision_id, 'ACTIVE' AS status,
  'text-' || document_id || '-' || CASE WHEN price < 300000 THEN text_version
    ELSE greatest(1, text_version - 1) END AS text_revision_id, created_at, 'run-' || document_id AS run_id
  FROM docs WHERE active_revision_id IS NOT NULL)""",
    "facts": """facts AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id,
  l_orderkey AS document_id,
  CASE l_returnflag WHEN 'N' THEN 'LAB_RESULT' WHEN 'A' THEN 'MEDICATION' ELSE 'CONDITION' END AS type,
  'part ' || l_partkey AS name, CASE WHEN l_linestatus = 'F' THEN 'qty ' || l_quantity::INT END AS value_text,
  CASE WHEN l_discount >= 0.05 THEN l_quantity END AS value_number, CASE WHEN l_tax < 0.04 THEN 'mg' END AS unit,
  l_shipdate::DATE AS event_date, CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'UNKNOWN' END AS assertion_status,
  CASE l_linenumber WHEN 2 THEN 'CONFIRMED' WHEN 3 THEN 'CORRECTED' WHEN 4 THEN 'REJECTED' ELSE 'UNREVIEWED' END
    AS review_status, l_tax < 0.07 AS active, l_shipdate AS created_at,
  CASE WHEN l_linenumber = 3 THEN 'Original  Part ' || l_partkey ELSE 'part ' || l_partkey END AS original_name,
  CASE WHEN l_discount >= 0.05 THEN l_quantity + (l_linenumber = 3)::INT END AS original_number
  FROM lineitem)""",
    "jobs": """jobs AS (SELECT event_id AS job_id, user_id AS document_id,
  CASE WHEN event_type = 'error' THEN 'REMOVE' WHEN event_type IN ('click', 'purchase') THEN 'PROCESS' ELSE 'INDEX' END
    AS operation,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'QUEUED' ELSE 'READY' END AS status,
  ceil(value / 100)::INT AS generation, ts AS created_at FROM events)""",
    "runs": """runs AS (SELECT 'run-' || document_id AS run_id, document_id,
  CASE WHEN price < 200000 THEN 'READY' ELSE 'FAILED' END AS status,
  CASE WHEN price < 150000 THEN text_version ELSE greatest(1, text_version - 1) END AS text_version, created_at
  FROM docs)""",
    "timeline": """timeline AS (SELECT document_id, CAST(NULL AS VARCHAR) AS fact_id, document_type AS event_type,
  document_date AS event_date, title, summary AS description FROM docs
  UNION ALL SELECT document_id, fact_id, type, event_date, name,
    concat_ws(' ', value_text, CAST(CAST(value_number AS BIGINT) AS VARCHAR), unit) FROM facts
  WHERE active AND review_status <> 'REJECTED')""",
    "versions": """versions AS (SELECT d.document_id, d.text_version,
  CASE WHEN d.active_revision_id IS NOT NULL THEN t.version ELSE r.text_version END AS facts_version
  FROM docs d LEFT JOIN revisions p ON p.revision_id = d.active_revision_id
  LEFT JOIN texts t ON t.text_revision_id = p.text_revision_id
  LEFT JOIN runs r ON r.document_id = d.document_id AND r.status = 'READY')""",
}


def ctes(*names: str) -> str:
    """``WITH`` clause of the named derivations, their own inputs first."""
    needs = {"texts": ["docs"], "revisions": ["docs"], "runs": ["docs"], "timeline": ["docs", "facts"],
             "versions": ["docs", "texts", "revisions", "runs"]}
    order: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(SQL[name] for name in order) + "\n"
