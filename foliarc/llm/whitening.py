"""Whitening of embeddings with MLlib's distributed block matrices.

Centred rows get gapless indices and become a BlockMatrix; its transpose times itself is the scatter
matrix, whose eigenvectors are found locally (dimensions squared, not rows). A second multiplication,
by the whitening matrix, projects the rows. Rows go in slabs of a fixed number of blocks, because a
multiplication plans with the list of its blocks on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import partitions, staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 1024
SLAB_BLOCKS = 1 << 16
# Entries beyond this have no exact long image under the scale.
LARGEST = float(1 << 50)
# Eigenvalues below this share of the trace are rounding, not variance.
NO_VARIANCE = 1e-12


def integral(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x array<long>) of rows whose vector is whole: not null, no null, non-finite or unrepresentable entry."""
    vector = F.col(vector_column).cast("array<double>")
    whole = vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is above all numbers
    x = F.transform(vector, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    return rows.filter(whole).select(F.col(id_column).alias("vec_id"), x.alias("x"))


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Gapless ``index`` from 0: row numbers inside the partitions of one write, plus what stands before each."""
    laid = staged(rows.withColumn("__mid", F.monotonically_increasing_id()), "vectors")
    part = F.shiftright("__mid", 33)
    sizes = laid.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    starts = np.cumsum([0] + [r["count"] for r in sizes]).tolist()
    table = rows.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "__at long, __start long")
    placed = laid.join(F.broadcast(table), part == F.col("__at"))
    index = F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1)
    return placed.select(index.alias("index"), *rows.columns), starts[-1]


def blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """BlockMatrix of rows (index, vector array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, width)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose inner dimension is summed in ``splits`` tasks for each block of the result.

    Python's ``multiply`` lacks this argument of the same method; without it one task would take
    all blocks of a product that has a single block.
    """
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    return times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and the columns that whiten; a component without variance has a NaN column."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    real = values > NO_VARIANCE * max(np.trace(covariance), 0.0)
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), np.nan)
    return values, vectors * signs * scale


def deviations(n: int, sums: list[int]):
    """Exact sum of (n x - S)^2; null where it is no long."""
    centre, largest = np.array(sums, dtype=object), (1 << 63) - 1

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype="Int64")
                continue
            x = np.stack(batch.to_numpy())
            low, high = x.min(axis=0).astype(object) * n - centre, x.max(axis=0).astype(object) * n - centre
            bound = sum(max(a * a, b * b) for a, b in zip(low, high))
            apart = x * n - centre.astype(np.int64) if bound <= largest and abs(n * int(np.abs(x).max(initial=0))) <= largest else x.astype(object) * n - centre
            found = [int(v) for v in (apart * apart).sum(axis=1)] if apart.size else [0] * len(x)
            yield pd.Series([v if v <= largest else None for v in found], dtype="Int64")

    return run


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component.

    Rows are dropped whose vector is null or has a null or non-finite entry (or one of 2^50 or more in
    size, whose scaled image is no exact long). Vectors of another length than the commonest (of equally
    common ones the longest) take no part. Repeated rows count and are answered each; null ids stay null;
    other columns are ignored; an empty table gives no rows. A component without variance (all vectors
    equal, or fewer independent rows than components) has ``whitened`` null; ``explained`` is null where
    there is no variance at all; ``identity_error`` is taken over the components with variance, 0 if none.
    ``deviation`` is null where it exceeds a long.
    """
    spark = rows.sparkSession
    splits = partitions(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = integral(rows, id_column, vector_column)
    lengths = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None or lengths["width"] == 0:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    fitted, n = indexed(usable.filter(F.size("x") == width))
    each = fitted.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in each.orderBy("at").collect()]  # a row for each dimension
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = staged(fitted.select("index", "vec_id", "x", F.zip_with(F.col("x").cast("array<double>"), mean, lambda c, m: c - m).alias("vector")), "centred")
    slabs = [(low, min(n, low + SLAB_BLOCKS * BLOCK_ROWS)) for low in range(0, n, SLAB_BLOCKS * BLOCK_ROWS)]

    def slab(frame: DataFrame, low: int, high: int, columns: int) -> BlockMatrix:
        some = frame.filter((F.col("index") >= low) & (F.col("index") < high))
        return blocks(some.withColumn("index", F.col("index") - low), high - low, columns)

    covariance = sum(scatter(slab(centred, *s, width), splits) for s in slabs) / n
    values, whitener = whitening_matrix((covariance + covariance.T) / 2, most)
    kept = whitener.shape[1]
    factor = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(width, kept, whitener.T.ravel()))], 1), width, kept)
    parts = []
    for low, high in slabs:
        product = slab(centred, low, high, width).multiply(factor).toIndexedRowMatrix()
        made = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)  # the rows as a DataFrame
        parts.append(made.select((F.col("index") + low).alias("index"), vector_to_array("vector").alias("vector")))
    projected = parts[0]
    for part in parts[1:]:
        projected = projected.unionByName(part)
    projected = staged(projected, "projected")
    real = [i for i in range(kept) if np.isfinite(whitener[:, i]).all()]
    pairs = [(i, j) for i in real for j in real if i <= j]
    error = 0.0
    if pairs:
        got = projected.agg(*[F.covar_pop(F.col("vector")[i], F.col("vector")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = float(np.trace(covariance))
    share = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    answers = centred.select("index", "vec_id", deviations(n, sums)("x").alias("deviation")).join(projected, "index")
    spread = answers.select("vec_id", "deviation", F.posexplode("vector").alias("at", "whitened"))
    return spread.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                         F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), F.get(share, F.col("at")).alias("explained"),
                         F.lit(float(error)).alias("identity_error"))
