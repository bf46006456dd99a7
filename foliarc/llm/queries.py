"""The numbered queries over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_hash_tree_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"), 40)


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from foliarc.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'none')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM src),
running AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS open
  FROM weighed),
level AS (
  SELECT rest, open FROM running WHERE NOT rest * w > cap * open ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT r.source, r.source_size, CASE WHEN r.rest * r.w > r.cap * r.open THEN r.cap::DOUBLE ELSE r.w * l.rest::DOUBLE / l.open END AS target
  FROM running r LEFT JOIN level l ON true),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM targets),
marked AS (
  SELECT *, round(target - times * source_size)::BIGINT AS due FROM whole),
passed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs)
SELECT p.doc_id, p.size, m.source_size, m.target, (m.times * p.size + greatest(0, least(p.size, m.due - p.before)))::BIGINT AS taken
FROM passed p JOIN marked m ON p.source IS NOT DISTINCT FROM m.source
"""


@query("op5_water_filled_mix", MIX_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.mixing import mix

    return mix(table(spark, folder, "documents"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from foliarc.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_suffix_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, folder, "documents"))


@query("op4_simhash_components")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op7_importance_resampling")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.quality import resample

    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_chunked_media")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.media import media_features

    return media_features(table(spark, folder, "documents"))


@query("op3_kmeans_tree_search")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.ann import search

    return search(table(spark, folder, "embeddings"))


@query("op10_chat_repair")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.chat import format_chats

    return format_chats(table(spark, folder, "conversations"))


@query("op11_block_matrix_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


@query("op12_word_first_language_id")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.language_id import predict

    return predict(table(spark, folder, "documents"))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND a >= 30),
split AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM candidates, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
firsts AS MATERIALIZED (SELECT s.*, c.a AS l FROM split s JOIN counts c ON c.lang = s.lang AND c.phrase = s.first),
cuts AS MATERIALIZED (
  SELECT s.lang, s.phrase, s.a, s.cut, s.l, c.a AS r, (s.a::HUGEINT * 2000000) // (s.l::HUGEINT + c.a) AS score
  FROM firsts s JOIN counts c ON c.lang = s.lang AND c.phrase = s.rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k),
inside AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
left_over AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
FROM left_over o JOIN totals t ON t.lang = o.lang
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op13_collocations", PHRASE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from foliarc.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))
