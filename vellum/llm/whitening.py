"""Whitening of embeddings with MLlib's RowMatrix over exactly centred rows.

Vectors become integers on a fixed grid. Each distinct one is fitted once: with n of them and
sums S for each dimension, n x - S is an exact integer, so (n x - S) / n is centred up to one
rounding. Their Gramian divided by n is the covariance. Its eigenvectors, found on the driver from
a matrix of dimensions by dimensions, are broadcast, and ``mapInPandas`` whitens every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import give_back, table, written

#: Steps of the grid in one unit of an entry, and the offset that keeps usual values positive.
GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Scaled entries beyond this are set to it: doubles hold no finer whole numbers there.
LARGEST = float(1 << 52)
SCHEMA = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def on_grid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, x) of whole numbers, of the vectors that are not null and hold finite entries only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = lambda e: F.floor(F.greatest(F.least(e.cast("double") * GRID, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET
    return rows.where(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, scaled).cast("array<long>").alias("x"))


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns; in parts of 2^26, so that no part leaves 64 bits."""
    low = (1 << 26) - 1
    return [(int(h) << 26) + int(lo) for h, lo in zip((x >> 26).sum(axis=0), (x & low).sum(axis=0))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and S, exactly. Tasks send one row a dimension for each batch, which Spark adds up."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = _exact_sums(_matrix(b["x"]))
                yield pd.DataFrame({"dim": range(-1, len(s)), "s": [str(len(b)), *map(str, s)]})

    added = fit.mapInPandas(sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_dim = {r["dim"]: int(r["s"]) for r in added.collect()}
    return by_dim.pop(-1, 0), [by_dim[d] for d in sorted(by_dim)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in 64 bits where it fits, else as Python integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        return [int(s) for s in (y * y).sum(axis=1)]
    return [sum(int(e) * int(e) for e in row) for row in y]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The Gramian of an array column, by RowMatrix; rows become vectors on the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return np.asarray(RowMatrix(vectors).computeGramianMatrix().toArray())


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns; those that are zero to double precision are left out."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    good = e > max(e[0], 0) * len(e) * np.finfo(float).eps * 8
    return e[good][:components], v[:, good][:, :components]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Project every vector on the principal components of the distinct vectors, scaled to unit variance.

    Returns id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (exact
    sum of (n x - S)^2, decimal), whitened, explained (share of the trace) and identity_error (largest
    absolute entry of the whitened covariance less the identity). Rows whose vector is null, empty or holds
    null or non-finite entries are dropped; so are those of another length than the most frequent
    one (ties: the shorter). Repeated rows and null ids stay rows. An empty table, or one whose vectors
    are all equal, has no component and gives an empty result. Other columns are never read.

    The driver holds matrices of dimensions by dimensions; the copies of one vector are merged before
    they are shuffled.
    """
    spark = rows.sparkSession
    grid = on_grid(rows, id_col, vector_col)
    lengths = grid.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), "k").first()
    empty = spark.createDataFrame([], SCHEMA).withColumnRenamed("id", id_col)
    if lengths is None:
        return empty
    grid = grid.where(F.size("x") == lengths["k"])
    fit = written(grid.select("x").distinct(), "whitening")
    n, sums = column_sums(fit)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"c": list((_centred(_matrix(b["x"]), n, sums) / n).astype(float))})

    covariance = gramian(fit.mapInPandas(centre, "c array<double>"), "c") / n
    values, vectors = principal(covariance, components)
    if not len(values):
        return empty
    shared = spark.sparkContext.broadcast((n, sums, vectors / np.sqrt(values)))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, to = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"w": list((_centred(_matrix(b["x"]), n, sums) / n).astype(float) @ to)})

    # the exact centre of the rows is zero, so whitened rows are centred as they are
    error = float(np.abs(gramian(fit.mapInPandas(scores, "w array<double>"), "w") / n - np.eye(len(values))).max())
    explained = values / np.trace(covariance)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, to = shared.value
        k = to.shape[1]
        for b in batches:
            if not len(b):
                continue
            y = _centred(_matrix(b["x"]), n, sums)
            w = (y / n).astype(float) @ to
            yield pd.DataFrame({
                "id": b["id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1), len(b)), "n": n,
                "deviation": np.repeat([Decimal(d) for d in _deviations(y)], k),
                "whitened": w.ravel(), "explained": np.tile(explained, len(b)), "identity_error": error,
            })
        give_back()

    return grid.mapInPandas(project, SCHEMA).withColumnRenamed("id", id_col)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every vector on the 16 largest components. A deviation beyond 64 bits is null."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
