"""Whitening of embeddings by their principal components, on MLlib's block matrices.

Vectors become integers (256 times each entry, rounded down). Each distinct vector is one row of a matrix; its centred rows
are indexed and dealt into blocks, the transpose times the matrix gives the scatter, numpy's eigh its eigenvectors, and the
matrix times the scaled eigenvectors the whitened rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logframe.llm.common import written

SCALE = 256
COMPONENTS = 4
#: Entries of a block, and the most columns that it has.
BLOCK_ENTRIES, BLOCK_COLUMNS = 1 << 16, 1024
#: Entries beyond this are no longer whole numbers as doubles; rows with such are left out as those that are not finite.
_LARGEST = float(2**53)
#: Eigenvalues below this share of the largest are rounding: those components have no direction.
_LEAST = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of distinct vectors, sums of each dimension, eigenvalues, and the projection's columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    projection: np.ndarray


def integer_vectors(embeddings: DataFrame, column: str = "embedding", *, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The ``keep`` columns with x (256 times each entry, rounded down) and its sha256, for rows whose vector is whole.

    Rows go whose vector is null or empty, or holds a null, an entry that is not finite, or one beyond 2 to the 53rd.
    """
    scaled = F.transform(F.col(column), lambda c: c.cast("double") * SCALE)
    fits = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _LARGEST))
    usable = embeddings.select(*keep, F.when(fits & (F.size(scaled) > 0), scaled).alias("x")).filter(F.col("x").isNotNull())
    whole = usable.withColumn("x", F.transform("x", lambda v: F.floor(v)))
    return whole.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ",").cast("binary"), 256)))


def _common_length(vectors: DataFrame) -> int:
    """The most frequent length of a vector, the longest where several are."""
    found = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.d if found else 0


def _indexed(fit: DataFrame) -> DataFrame:
    """The rows with an index from 0 without gaps: what their task wrote before them, and what the tasks before it wrote."""
    task, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = fit.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    offsets = {r.task: r.before or 0 for r in counts.select("task", before.alias("before")).collect()}
    base = F.create_map(*[F.lit(v) for item in offsets.items() for v in item])
    return fit.withColumn("index", F.element_at(base, task) + place)


def _centred(sums: list[int], n: int) -> Column:
    means = F.array(*[F.lit(s / n) for s in sums])
    return F.zip_with("x", means, lambda v, m: v.cast("double") - m)


def _blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Rows (index, values) as a block matrix; the rows never pass through Python."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    matrix = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, d))
    columns = min(d, BLOCK_COLUMNS)
    return matrix.toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def _times(left: BlockMatrix, right: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """The product; the inner dimension is split into parts, so no task multiplies all blocks of a column."""
    a, b = left._java_matrix_wrapper._java_model, right._java_matrix_wrapper._java_model
    return BlockMatrix(a.multiply(b, parts), left.rowsPerBlock, right.colsPerBlock)


def _release(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _local_blocks(spark, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small matrix as blocks of so many rows."""
    k = matrix.shape[1]
    parts = [matrix[i : i + rows_per_block] for i in range(0, len(matrix), rows_per_block)]
    blocks = [((i, 0), DenseMatrix(len(p), k, p.flatten(order="F").tolist())) for i, p in enumerate(parts)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), rows_per_block, k, len(matrix), k)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of vectors, exact sums of each dimension, largest absolute entry."""
    cells = fit.select(F.posexplode("x").alias("at", "v"))
    found = cells.groupBy("at").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.max(F.abs("v")).alias("most")
    )
    rows = {r["at"]: r for r in found.collect()}  # a row for each dimension
    return rows[0]["n"], [int(rows[i]["s"]) for i in range(d)], max(int(r["most"]) for r in rows.values())


def _deviation(n: int, sums: list[int], most: int) -> Column:
    """The sum over dimensions of (n*x - S)^2, exact: as longs where they suffice, else as decimals, null beyond 38 digits."""
    wide = len(sums) * (2 * n * most) ** 2 >= 2**63
    kind = "decimal(38,0)" if wide else "long"
    both = F.arrays_zip(F.col("x").alias("v"), F.array(*[F.lit(s).cast(kind) for s in sums]).alias("s"))
    if not wide:
        return F.aggregate(both, F.lit(0).cast("long"), lambda t, p: t + (F.lit(n) * p["v"] - p["s"]) * (F.lit(n) * p["v"] - p["s"])).cast("decimal(38,0)")

    def add(total: Column, p: Column) -> Column:
        off = F.lit(n).cast("decimal(19,0)") * p["v"].cast("decimal(19,0)") - p["s"]
        return F.try_add(total, F.try_multiply(off.cast(kind), off.cast(kind)).cast(kind)).cast(kind)

    return F.aggregate(both, F.lit(0).cast(kind), add)


def _eigen(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, their share of the trace, and eigenvectors over their roots."""
    covariance = scatter / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > _LEAST * max(values[0], 0)).sum())
    return values[:k], values[:k] / np.trace(covariance), vectors[:, :k] / np.sqrt(values[:k])


def whiten(
    embeddings: DataFrame, column: str = "embedding", *, keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS
) -> tuple[DataFrame, Whitening | None]:
    """Whitened coordinates of every row, and what was fitted on the distinct vectors (divisor n, centred first).

    Returns a row for each usable row and component: the ``keep`` columns, component (from 1, by falling eigenvalue), n,
    deviation (decimal: the sum over dimensions of (n*x - S)^2, null beyond 38 digits), whitened, explained and
    identity_error (the largest absolute entry of the whitened distinct vectors' covariance minus the identity).

    Unusable vectors go (see ``integer_vectors``), and so do those of another length than the most frequent one (the longer of
    two). Repeated vectors are fitted once and returned as often as they occur; equal eigenvalues may give any of their
    directions. Components without variance are left out, so equal vectors only, or an empty table, give no rows; the
    fit is then None. A null or repeated vec_id is a value like any other; columns of any name are left alone.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, column, keep=keep)
    d = _common_length(vectors)
    vectors = vectors.filter(F.size("x") == d)
    names = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in embeddings.select(*keep).schema), _RESULT]
    empty = spark.createDataFrame([], ", ".join(names))
    if not d:
        return empty, None
    fit = written(vectors.groupBy("digest").agg(F.first("x").alias("x")).withColumn("place", F.monotonically_increasing_id()), "vectors")
    n, sums, most = _sums(fit, d)
    rows = _indexed(fit)
    # Both products read the blocks; a lost one is dealt again.
    matrix = _blocks(rows.select("index", _centred(sums, n).alias("values")), n, d).persist(StorageLevel.MEMORY_AND_DISK)
    scatter = _times(matrix.transpose(), matrix, max(1, matrix.numRowBlocks // 4)).toLocalMatrix().toArray()
    values, explained, projection = _eigen(scatter, n, components)
    if not len(values):
        _release(matrix)
        return empty, None
    projected = _times(matrix, _local_blocks(spark, projection, matrix.colsPerBlock)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    found = found.select(F.col("index"), vector_to_array("vector").alias("y"))
    whole = rows.join(found, "index").select("digest", _deviation(n, sums, most).alias("deviation"), "y")
    whitened = written(whole, "whitened")
    _release(matrix)
    error = _identity_error(whitened, len(values))
    share = F.array(*[F.lit(float(e)) for e in explained])
    out = vectors.select("digest", *keep).join(whitened, "digest").select(*keep, "deviation", F.posexplode("y").alias("at", "whitened"))
    out = out.select(
        *keep, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
    return out, Whitening(n, sums, values, explained, projection)


_RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _identity_error(whitened: DataFrame, k: int) -> float:
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    y = [F.get("y", F.lit(i)) for i in range(k)]
    found = whitened.agg(*[F.covar_pop(y[i], y[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, cells))
