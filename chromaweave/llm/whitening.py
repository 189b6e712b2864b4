"""Whitening of embeddings: covariance by column aggregates, eigenvectors by LAPACK, projection by blocks of rows.

The covariance of d dimensions is one aggregation with a generated SQL expression for each pair of the upper triangle, so
each task sends d(d + 1) / 2 sums and no row. What reaches the driver is those sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of this size and beyond count as not finite: their sums would not fit a long.
_OUT_OF_RANGE = float(2**31)
#: Pairs of one aggregation: all of 120 dimensions; more dimensions take several aggregations.
_PAIRS = 7_260
#: Eigenvalues below this share of the largest are taken as 0, and have no component.
_NIL = 1e-11


@dataclass
class Whitening:
    """What is fitted: rows, sums and mean of each dimension, falling eigenvalues, unit eigenvectors in columns, trace."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, int]:
    """(key, x) of the vectors that take part, x being ``floor(scale * c) + shift`` of each entry as longs, and their dimension.

    Left out are vectors that are null or empty or hold null, non-finite or out-of-range entries (2^31 and beyond), and those of
    another length than most have (of lengths equally frequent, the longest counts). Dimension 0: there is none.
    """
    entries = F.transform(column, lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).alias("key"), entries.alias("c")).where(F.size("c") > 0).where(~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _OUT_OF_RANGE)))
    most = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("c") == d).select("key", F.transform("c", lambda c: F.floor(c * float(scale)) + F.lit(shift)).alias("x")), d


def means(rows: DataFrame, array: str, d: int) -> np.ndarray:
    """Of each entry of an array column, over all rows."""
    got = rows.sparkSession.sql(f"SELECT {', '.join(f'avg({array}[{k}])' for k in range(d))} FROM {{rows}}", rows=rows).first()
    return np.array(got, float)


def covariance(rows: DataFrame, array: str, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of an array column's entries: products of centred entries, summed for each pair of the upper
    triangle in one aggregation."""
    d = len(centre)
    centred = rows.sparkSession.sql(f"SELECT {', '.join(f'nvl(CAST({array}[{k}] AS DOUBLE) - {float(centre[k])!r}D, 0D) AS y{k}' for k in range(d))} FROM {{rows}}", rows=rows)  # never null: half the generated code
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    made = np.zeros((d, d))
    for at in range(0, len(pairs), _PAIRS):
        some = pairs[at : at + _PAIRS]
        sums = rows.sparkSession.sql(f"SELECT {', '.join(f'sum(y{i} * y{j})' for i, j in some)} FROM {{rows}}", rows=centred).first()
        for (i, j), s in zip(some, sums):
            made[i, j] = made[j, i] = s / n
    return made


def fit_whitening(rows: DataFrame, d: int) -> Whitening | None:
    """Fit on all ``rows`` (key, x); None if there are none. Of an eigenvector's two signs the one is taken whose largest entry
    is positive."""
    if not d:
        return None
    n, *sums = rows.sparkSession.sql(f"SELECT count(*), {', '.join(f'sum(x[{k}])' for k in range(d))} FROM {{rows}}", rows=rows).first()
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    v = covariance(rows, "x", mean, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(d)]
    return Whitening(n, list(sums), mean, values, vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(v)))


def _projected(mean: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            made = (values - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * axes.shape[1], pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that takes part (``whole_vectors``) and component: the key, component (from 1, by falling eigenvalue),
    n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of ``(n * x - S)^2``, null where it does not fit a long. ``identity_error`` is measured: the
    covariance of ``whitened`` over all rows, less the identity. Directions without variance (eigenvalue under 1e-11 of the largest)
    have no component, so equal vectors, or a single one, have no rows. Repeated keys and null keys are rows like others; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows, d = whole_vectors(vectors, key, column)
    fitted = fit_whitening(rows, d)
    k = 0 if fitted is None else int((fitted.values[:components] > _NIL * max(float(fitted.values[0]), 0.0)).sum())
    if not k:
        return spark.createDataFrame([], schema)
    sums = F.array(*[F.lit(s).cast("bigint") for s in fitted.sums])
    off = F.zip_with("x", sums, lambda x, s: (F.lit(fitted.n).cast("bigint") * x - s).cast("decimal(19,0)"))
    exact = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    axes = fitted.vectors[:, :k] / np.sqrt(fitted.values[:k])
    measured = rows.select("key", exact.try_cast("bigint").alias("deviation"), "x")
    projected = measured.mapInArrow(_projected(fitted.mean, axes), f"key {kind}, deviation bigint, w array<double>")
    error = np.abs(covariance(projected, "w", means(projected, "w", k), fitted.n) - np.eye(k)).max()
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values[:k]])
    long = projected.select("key", "deviation", F.posexplode("w").alias("p", "whitened"))
    return long.select(F.col("key").alias(key), (F.col("p") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("p")).alias("explained"), F.lit(float(error)).alias("identity_error"))
