"""Retrieval over the test tables: benchmark texts ask, documents answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.functions import ranking
from foliarc.functions.text import tokens
from foliarc.operators import chunks as ch
from foliarc.operators import retrieve
from foliarc.plans.registry import Tables, query
from foliarc.session import durable, spread

FOLD = "replace(replace(lower({0}),'ß','ss'),'ς','σ')"


def sql_tokens(column: str) -> str:
    found = f"regexp_extract_all({FOLD.format(column)}, '[\\p{{L}}\\p{{N}}_]+')"
    return f"CASE WHEN len({found}) = 0 THEN ['_'] ELSE {found} END"


BM25_CTES = f"""
c AS (SELECT doc_id AS chunk_id, {sql_tokens('text')} AS words FROM documents),
t AS (SELECT chunk_id, len(words) AS dl, unnest(words) AS token FROM c),
tf AS (SELECT chunk_id, dl, token, count(*) AS f FROM t GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM c),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
mean AS (SELECT avg(r) AS m FROM raw),
idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, mean),
q AS (SELECT item_id AS question_id, unnest({sql_tokens('text')}) AS token FROM benchmark),
qt AS (SELECT question_id, token, count(*) AS qtf FROM q GROUP BY ALL),
sc AS (SELECT question_id, chunk_id,
         round(sum(qtf * idf * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 8) AS score
       FROM qt JOIN tf USING (token) JOIN idf USING (token), st GROUP BY ALL),
grid AS (SELECT b.item_id AS question_id, d.doc_id AS chunk_id, coalesce(score, 0.0) AS score
         FROM benchmark b CROSS JOIN documents d
         LEFT JOIN sc ON sc.question_id = b.item_id AND sc.chunk_id = d.doc_id),
sparse AS (SELECT question_id, chunk_id, score,
             row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM grid)
"""


def sql_vector(table: str, key: str, alias: str) -> str:
    found = f"regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+')"
    return f"""
{alias}_w AS (SELECT {key} AS id, unnest({found}) AS w FROM {table}),
{alias}_b AS (SELECT id, CAST('0x' || substr(sha256(w), 1, 8) AS UBIGINT) % 32 AS slot, count(*)::DOUBLE AS v
              FROM {alias}_w GROUP BY ALL),
{alias}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {alias}_b GROUP BY id)"""


DENSE_CTES = f"""{sql_vector('documents', 'doc_id', 'dv')},{sql_vector('benchmark', 'item_id', 'qv')},
dots AS (SELECT q.id AS question_id, d.id AS chunk_id, sum(q.v * d.v) AS dp FROM qv_b q JOIN dv_b d USING (slot)
         GROUP BY ALL),
dist AS (SELECT b.item_id AS question_id, d.doc_id AS chunk_id,
           round(1.0 - coalesce(dp / (qn.norm * dn.norm), 0.0), 8) AS distance
         FROM benchmark b CROSS JOIN documents d
         LEFT JOIN dots ON dots.question_id = b.item_id AND dots.chunk_id = d.doc_id
         LEFT JOIN qv_n qn ON qn.id = b.item_id LEFT JOIN dv_n dn ON dn.id = d.doc_id),
dense AS (SELECT question_id, chunk_id, distance,
            row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS dense_rank FROM dist)
"""

FUSED_CTES = """
s AS (SELECT question_id, chunk_id, sparse_rank FROM sparse WHERE sparse_rank <= {depth}),
d AS (SELECT question_id, chunk_id, dense_rank FROM dense WHERE dense_rank <= {depth}),
fu AS (SELECT question_id, chunk_id, sparse_rank, dense_rank,
         round(coalesce(0.5 / (60 + sparse_rank), 0.0) + coalesce(0.5 / (60 + dense_rank), 0.0), 8) AS rrf
       FROM s FULL JOIN d USING (question_id, chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id
             ORDER BY rrf DESC, sparse_rank ASC NULLS LAST, dense_rank ASC NULLS LAST) AS rank FROM fu)
"""


def questions(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("question_id"), "text",
                              retrieve.hashed_vector(F.col("text")).alias("embedding"))


def chunks(t: Tables):
    return spread(t.documents, "doc_id").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text",
                              retrieve.hashed_vector(F.col("text")).alias("embedding"))


@query("func_1_tokenize", f"""
SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_distinct,
       ({sql_tokens('text')})[1] AS first_token FROM documents""")
def tokenize(t: Tables):
    words = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(words).cast("bigint").alias("n_tokens"),
                              F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
                              F.element_at(words, 1).alias("first_token"))


@query("agg_9_bm25_statistics", f"""
WITH {BM25_CTES}
SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, round(m, 6) AS mean_idf,
       (SELECT count(*) FROM df) AS vocabulary, (SELECT CAST(sum(df) AS BIGINT) FROM df) AS postings FROM st, mean""")
def statistics(t: Tables):
    terms = retrieve.vocabulary(chunks(t))
    sizes = terms.groupBy("scope").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("df").alias("postings"))
    return retrieve.corpus_statistics(chunks(t)).join(sizes, "scope").select(
        "n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "vocabulary", "postings")


@query("func_24_bm25_score", f"""
WITH {BM25_CTES} SELECT question_id, count(*) AS matched, round(max(score), 6) AS best, round(sum(score), 4) AS total
FROM sc GROUP BY question_id""")
def bm25_score(t: Tables):
    return retrieve.sparse_scores(questions(t), chunks(t)).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("matched"), F.round(F.max("score"), 6).alias("best"),
        F.round(F.sum("score"), 4).alias("total"))


@query("bm25_top5", f"""
WITH {BM25_CTES}
SELECT question_id, chunk_id, round(score, 6) AS score, sparse_rank AS rank FROM sparse WHERE sparse_rank <= 5""")
def bm25_top5(t: Tables):
    return retrieve.sparse_ranks(questions(t), chunks(t), 5).select(
        "question_id", "chunk_id", F.round("score", 6).alias("score"), F.col("sparse_rank").alias("rank"))


@query("win_4_rank_positions", f"""
WITH {BM25_CTES}, {DENSE_CTES}, {FUSED_CTES.format(depth=10)}
SELECT question_id, chunk_id, sparse_rank, dense_rank FROM fu""")
def rank_positions(t: Tables):
    q, c = questions(t), chunks(t)
    return retrieve.fuse_ranks(retrieve.sparse_ranks(q, c, 10), retrieve.dense_ranks(q, c, 10), 20).select(
        "question_id", "chunk_id", "sparse_rank", "dense_rank")


@query("hybrid_retrieve", f"""
WITH {BM25_CTES}, {DENSE_CTES}, {FUSED_CTES.format(depth=10)}
SELECT question_id, chunk_id, sparse_rank, dense_rank, round(rrf, 6) AS rrf, rank FROM ranked WHERE rank <= 5""")
def hybrid(t: Tables):
    return retrieve.hybrid_retrieve(questions(t), chunks(t)).withColumn("rrf", F.round("rrf", 6))


@query("srt_4_hybrid_top20", f"""
WITH {BM25_CTES}, {DENSE_CTES}, {FUSED_CTES.format(depth=40)}
SELECT question_id, chunk_id, rank FROM ranked WHERE rank <= 20""")
def hybrid_top20(t: Tables):
    return retrieve.hybrid_retrieve(questions(t), chunks(t), 20).select("question_id", "chunk_id", "rank")


@query("srt_8_retrieve_strategy", f"""
WITH {BM25_CTES}, {DENSE_CTES}, {FUSED_CTES.format(depth=24)}
SELECT 'bm2512' AS strategy, question_id, chunk_id, sparse_rank AS rank FROM sparse WHERE sparse_rank <= 12
UNION ALL SELECT 'dense12', question_id, chunk_id, dense_rank FROM dense WHERE dense_rank <= 12
UNION ALL SELECT s, question_id, chunk_id, rank FROM ranked, (SELECT unnest(['hybrid12', 'scan']) AS s) WHERE rank <= 12""")
def strategies(t: Tables):
    q, c = questions(t), retrieve.stored_chunks(chunks(t))
    counts = durable(retrieve.word_counts(c))
    frames = [retrieve.retrieve_strategy(name, q, c, counts=counts).withColumn("strategy", F.lit(name))
              for name in ("bm2512", "dense12", "hybrid12", "scan")]
    return reduce(DataFrame.unionByName, frames)


def indexed_chunks(t: Tables):
    """Chunks of two revisions of every document; the second is active, and none where the id ends in 9."""
    d = t.documents
    revisions = d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.explode(F.array(
        F.struct(F.lit("r1").alias("id"), F.lit(1).alias("version"), F.concat(F.lit("Superseded. "), "text").alias("text")),
        F.struct(F.lit("r2").alias("id"), F.lit(2).alias("version"), F.col("text").alias("text")))).alias("r")).select(
        "document_id", "title", F.col("r.version").alias("version"), F.col("r.id").alias("revision_id"), F.col("r.text").alias("text"),
        F.array().cast("array<struct<page_number:int,text:string>>").alias("pages"))
    active = t.documents.filter("doc_id % 10 <> 9").select(F.col("doc_id").alias("document_id"), F.lit("r2").alias("active_revision_id"))
    # A chunk is visible if its revision is, whatever its text: superseded revisions are not split at all.
    return ch.document_chunks(spread(retrieve.visible_chunks(revisions, active), "document_id"), revision=True)


@query("index_and_retrieve")
def index_and_retrieve(t: Tables):
    """Split, index, restrict to active revisions and rank the chunks for every question."""
    visible = retrieve.stored_chunks(indexed_chunks(t).withColumn("embedding", retrieve.hashed_vector(F.col("text"))))
    return retrieve.hybrid_retrieve(questions(t), visible, counts=durable(retrieve.word_counts(visible))).join(
        visible.select("chunk_id", "document_id", "position"), "chunk_id").select(
        "question_id", "rank", "document_id", "position", "sparse_rank", "dense_rank", F.round("rrf", 6).alias("rrf"))


@query("index_visible_documents", """
SELECT doc_id AS document_id, 'r2' AS revision_id, 1::BIGINT AS first_position FROM documents WHERE doc_id % 10 <> 9 AND regexp_matches(text, '\\S')""")
def index_visible_documents(t: Tables):
    return indexed_chunks(t).groupBy("document_id", "revision_id").agg(F.min("position").cast("bigint").alias("first_position"))


@query("func_26_hashed_vector", f"""
WITH {sql_vector('documents', 'doc_id', 'dv')[1:]}
SELECT id AS doc_id, CAST(slot AS BIGINT) AS slot, v AS weight FROM dv_b""")
def vectors(t: Tables):
    return (spread(t.documents, "doc_id").select("doc_id", F.posexplode_outer(retrieve.hashed_vector(F.col("text"))).alias("slot", "weight"))
            .filter("weight > 0").select("doc_id", F.col("slot").cast("bigint").alias("slot"),
                                         F.col("weight").cast("double").alias("weight")))


CENTROIDS = """
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
q AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL),
qn AS (SELECT label, sqrt(sum(v * v)) AS n FROM q GROUP BY label),
xn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id),
dp AS (SELECT q.label AS question_id, x.vec_id AS chunk_id, sum(q.v * x.v) AS p FROM q JOIN x USING (i) GROUP BY ALL),
di AS (SELECT question_id, chunk_id, round(1 - p / (qn.n * xn.n), 8) AS distance
       FROM dp JOIN qn ON qn.label = question_id JOIN xn ON xn.vec_id = chunk_id)"""


def centroids(t: Tables):
    """One question per label: the mean vector of the label's chunks."""
    means = (t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
             .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")))
    return means.groupBy(F.col("label").alias("question_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("embedding"))


@query("func_23_cosine_distance", f"""
WITH {CENTROIDS} SELECT e.vec_id, round(1 - p / (qn.n * xn.n), 6) AS distance
FROM dp JOIN embeddings e ON e.vec_id = dp.chunk_id AND e.label = dp.question_id
JOIN qn ON qn.label = question_id JOIN xn ON xn.vec_id = chunk_id""")
def cosine(t: Tables):
    own = t.embeddings.join(F.broadcast(centroids(t).withColumnRenamed("embedding", "centre")),
                            F.col("label") == F.col("question_id"))
    return own.select("vec_id", F.round(ranking.cosine_distance(F.col("centre"), F.col("embedding")), 6)
                      .alias("distance"))


@query("jn_10_question_chunk_dense", f"""
WITH {CENTROIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
FROM di) SELECT CAST(question_id AS BIGINT) AS question_id, chunk_id, round(distance, 6) AS distance, rank
FROM r WHERE rank <= 20""")
def dense(t: Tables):
    vectors_ = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieve.dense_ranks(centroids(t), vectors_, 20).select(
        F.col("question_id").cast("bigint").alias("question_id"), "chunk_id",
        F.round("distance", 6).alias("distance"), F.col("dense_rank").alias("rank"))


@query("func_25_rrf_score", f"""
WITH {BM25_CTES}, {DENSE_CTES}, {FUSED_CTES.format(depth=10)}
SELECT question_id, count(*) AS fused, round(max(rrf), 6) AS best, round(sum(rrf), 6) AS total
FROM fu GROUP BY question_id""")
def rrf(t: Tables):
    q, c = questions(t), chunks(t)
    fused = retrieve.fuse_ranks(retrieve.sparse_ranks(q, c, 10), retrieve.dense_ranks(q, c, 10), 20)
    return fused.groupBy("question_id").agg(F.count(F.lit(1)).alias("fused"), F.round(F.max("rrf"), 6).alias("best"),
                                            F.round(F.sum("rrf"), 6).alias("total"))
