"""Ranking expressions: BM25 term weight, cosine distance and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.5
B = 0.75
EPSILON = 0.25
RRF_WEIGHT = 0.5
RRF_C = 60


def raw_idf(corpus_size: Column, df: Column) -> Column:
    return F.log(corpus_size - df + 0.5) - F.log(df + 0.5)


def bm25_term(idf: Column, frequency: Column, length: Column, mean_length: Column) -> Column:
    return idf * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda total, product: total + product)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fused_score(sparse_rank: Column, dense_rank: Column) -> Column:
    """Weighted reciprocal ranks; a missing rank adds nothing."""
    return (F.coalesce(F.lit(RRF_WEIGHT) / (F.lit(RRF_C) + sparse_rank), F.lit(0.0))
            + F.coalesce(F.lit(RRF_WEIGHT) / (F.lit(RRF_C) + dense_rank), F.lit(0.0)))
