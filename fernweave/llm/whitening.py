"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition keeps its number of vectors, their sums, and all singular values and right vectors about its mean. Merging two
such summaries stacks the scaled vectors and one row for the distance of the means, and decomposes again, so no dimension
is lost. Summaries merge in groups of a fixed number until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reachable, table, written

#: Rows that one decomposition takes at most, besides what it holds already.
ROWS = 4096


def quantised(vector: Column, scale: int = 256) -> Column:
    """array<long>: floor(scale * entry) of each entry as double, at most 2^63 - 1 in size."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Whether the vector is there, isn't empty, and has no null, infinite or NaN entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


@dataclass
class Summary:
    """What a set of vectors comes to: number, exact sums, and values * vectors about the mean (rows, as many as dimensions)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """x: int64, one row a vector."""
        # halves keep the sums of up to 2^31 rows exact
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        sums = [(int(h) << 32) + int(w) for h, w in zip(high, low)]
        centred = x.astype(np.float64) - np.array([s / len(x) for s in sums])
        return Summary(len(x), sums, *_decomposed(centred))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        rows = [self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, np.sqrt(self.n / n * other.n) * gap[None]]
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], *_decomposed(np.vstack(rows)))

    def packed(self, slot: int) -> pd.DataFrame:
        return pd.DataFrame({"slot": [slot], "n": [self.n], "sums": [[str(s) for s in self.sums]], "sv": [self.values.tolist()], "vectors": [self.vectors.ravel().tolist()]})

    @staticmethod
    def unpacked(row) -> Summary:
        values = np.asarray(row.sv, np.float64)
        return Summary(int(row.n), [int(s) for s in row.sums], values, np.asarray(row.vectors, np.float64).reshape(len(values), len(row.sums)))


PACKED = "slot long, n long, sums array<string>, sv array<double>, vectors array<double>"


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of rows, as many as dimensions (zeros where there are fewer rows)."""
    dim = rows.shape[1]
    if len(rows) < dim:
        rows = np.vstack([rows, np.zeros((dim - len(rows), dim))])
    if len(rows) > 2 * dim:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def _matrix(column: pa.ListArray, dim: int, dtype) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def _summaries(fit: DataFrame, dim: int) -> DataFrame:
    """One row a partition of fit (x array<long>, dim entries each) that has rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = Summary.of(_matrix(batch.column(0).slice(at, ROWS), dim, np.int64))
                own = part if own is None else own.merged(part)
        if own is not None:
            yield pa.RecordBatch.from_pandas(own.packed(0), preserve_index=False)

    return fit.select("x").mapInArrow(summarise, PACKED).withColumn("slot", F.spark_partition_id().cast("long"))


def fitted(fit: DataFrame, dim: int, together: int = 8) -> Summary | None:
    """The summary of all rows of fit; None where it is empty. Summaries meet in groups of `together`, level by level."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        parts = [Summary.unpacked(r) for r in pdf.itertuples()]
        own = parts[0]
        for part in parts[1:]:
            own = own.merged(part)
        return own.packed(int(pdf["to"].iat[0]))

    level = written(_summaries(fit, dim))
    top = level.agg(F.max("slot")).first()[0] or 0
    while top > 0:
        top //= together
        level = level.withColumn("to", F.floor(F.col("slot") / together)).groupBy("to").applyInPandas(merge, PACKED)
    row = level.first()
    return None if row is None else Summary.unpacked(row)


@dataclass
class Whitening:
    """A fitted whitening: number and sums of the fit list, eigenvalues of its covariance (falling), components as rows."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def rank(self) -> int:
        """Components whose variance is more than rounding."""
        floor = (self.eigenvalues[0] if len(self.eigenvalues) else 0.0) * (len(self.eigenvalues) * np.finfo(float).eps) ** 2
        return int((self.eigenvalues > floor).sum())

    @property
    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.zeros_like(self.eigenvalues)


def whitened(rows: DataFrame, fit: Whitening, components: int, x_col: str = "x") -> DataFrame:
    """rows with deviation (decimal(38,0), exact) and whitened (array of `components` doubles, fewer where vectors are shorter).

    deviation: the sum over dimensions of (n * x - S)^2; null beyond 38 digits. A component without variance gives 0.
    """
    count, dim = min(components, len(fit.sums)), len(fit.sums)
    high = np.array([s // fit.n for s in fit.sums], object)
    # x - S/n as (x - floor(S/n)) - rest keeps digits that a division of large sums would lose
    whole = np.array([int(h) for h in high], np.float64)
    rest = np.array([(s - int(h) * fit.n) / fit.n for s, h in zip(fit.sums, high)])
    scale = np.array([1 / np.sqrt(e) if i < fit.rank else 0.0 for i, e in enumerate(fit.eigenvalues[:count])])
    projection = fit.components[:count].T * scale
    sums, n = list(fit.sums), fit.n
    # below this size of n * x - S no sum of squares leaves 63 bits
    safe = int(np.sqrt((1 << 62) // dim))

    def apply(x: pd.Series) -> pd.DataFrame:
        m = np.array(x.tolist(), np.int64).reshape(-1, dim)
        out = ((m.astype(np.float64) - whole) - rest) @ projection
        top = max((abs(int(v)) for v in (m.max(initial=0), m.min(initial=0))), default=0)
        if n * top + max(abs(s) for s in sums) < safe:
            gap = n * m - np.array(sums, np.int64)
            exact = [str(v) for v in (gap * gap).sum(axis=1)]
        else:
            exact = [str(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))) for row in m]
        return pd.DataFrame({"deviation": exact, "whitened": list(out)})

    applied = F.pandas_udf(apply, "deviation string, whitened array<double>")
    out = rows.withColumn("both", applied(x_col))
    return out.withColumns({"deviation": F.expr("try_cast(both.deviation as decimal(38,0))"), "whitened": F.col("both.whitened")}).drop("both")


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> tuple[DataFrame, Whitening | None, float | None]:
    """One row per usable row of embeddings and component; the fitted whitening (None without rows); the identity error.

    Columns: id_col, component (int, from 1), n, deviation decimal(38,0), whitened, explained.

    Each entry becomes x = floor(scale * entry). The whitening is fitted on each distinct x once. Its components are those
    of x's covariance by falling eigenvalue. The identity error is the largest absolute entry of whitened's
    covariance over the fit list minus the identity, over components that have variance.

    Null vectors, empty ones and those with a null, infinite or NaN entry are dropped. Where lengths differ, the length of
    most distinct vectors (of those, the largest) holds and others are dropped. Entries whose x is beyond 64 bits are the nearest long. Repeated
    vectors count once in the fit and keep a row each. Equal eigenvalues have components that are one choice of many,
    the same for all rows. Components without variance have whitened and explained 0. Null ids stay.

    Only distinct vectors are shuffled, after each task has dropped its own repeats. The driver sees one summary, of
    dim * dim numbers, and a number for each partition.
    """
    spark = embeddings.sparkSession
    reachable(spark)
    vector = embeddings[vector_col]
    rows = embeddings.select(embeddings[id_col].alias("id"), F.when(usable(vector), quantised(vector, scale)).alias("x")).filter("x is not null")
    distinct = written(rows.select("x").distinct())
    length = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = f"id {embeddings.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if length is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), None, None
    dim = length.dim
    fit_list = distinct.filter(F.size("x") == dim)
    summary = fitted(fit_list, dim)
    fit = Whitening(summary.n, summary.sums, summary.values**2 / summary.n, summary.vectors)
    error = _identity_error(whitened(fit_list, fit, components), min(components, dim, fit.rank))
    out = whitened(rows.filter(F.size("x") == dim), fit, components)
    explained = F.array(*[F.lit(float(e)) for e in fit.explained[: min(components, dim)]])
    out = out.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return (
        out.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained")),
        fit,
        error,
    )


def _identity_error(fit_list: DataFrame, count: int) -> float:
    """By Spark's own covariance, which centres as it goes."""
    if not count:
        return 0.0
    w = [F.col("whitened")[i] for i in range(count)]
    row = fit_list.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(count) for j in range(i + 1)]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in range(count) for j in range(i + 1))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, error = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumns({"deviation": F.expr("try_cast(deviation as long)"), "identity_error": F.lit(error).cast("double")})
