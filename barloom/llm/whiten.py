"""Whitening of embeddings along the leading eigenvectors of their covariance.

Components become whole numbers ``floor(scale * c) + offset``. Sums and products are exact: a first pass adds
up each dimension, a second one the products of what is left after taking away the whole number nearest to the mean, so that
the covariance is rounded once, at the end, whatever the offset. Both passes send one small array a task. The driver
finds the eigenpairs (``spectrum``) of a matrix as wide as the vectors are long, which doesn't grow with the rows. A
third pass projects; the covariance of what comes out is computed from the rows as written.

Defined results: vectors that are null or hold a null or non-finite element are left out; a shorter vector is filled
up with zeros to the longest; rows that repeat an id, or have none, are rows of their own; eigenvalues that are zero to
double precision give no components, so equal vectors, a single one and an empty table give no rows;
``deviation`` is null where it doesn't fit a long. A component with a whole number beyond 2**52 fails the job.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import storage
from barloom.llm import common, spectrum, vectors

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
_EXACT = 2**53
_TOTAL = pa.decimal128(38, 0)


def _numbers(batch: pa.RecordBatch, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    good, values, lengths = vectors.usable(batch.column("v"))
    return good, vectors.floors(values, scale) + offset, lengths


def _exact_sum(matrix: np.ndarray) -> np.ndarray:
    """Sums of whole-numbered columns, as Python numbers where doubles would round."""
    if matrix.size and np.abs(matrix).max() * len(matrix) >= _EXACT:
        return matrix.astype(np.int64).astype(object).sum(axis=0)
    return matrix.sum(axis=0).astype(np.int64).astype(object)


def _exact_products(matrix: np.ndarray) -> np.ndarray:
    """``matrix.T @ matrix`` of whole numbers, exactly."""
    largest = float(np.abs(matrix).max()) if matrix.size else 0.0
    rows = int((_EXACT - 1) / largest**2) if largest else len(matrix)
    if rows < 1:
        whole = matrix.astype(np.int64).astype(object)
        return whole.T @ whole
    out = np.zeros((matrix.shape[1],) * 2, object)
    for at in range(0, len(matrix), rows):
        part = matrix[at : at + rows]
        out = out + (part.T @ part).astype(np.int64)
    return out


def _totals(rows: DataFrame, scale: int, offset: int) -> tuple[int, list[int]]:
    """The number of usable vectors and the sums of their dimensions."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts, sums = 0, np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            _, x, _ = _numbers(batch, scale, offset)
            n, width = n + len(x), max(len(sums), x.shape[1])
            counts, sums = (np.concatenate([a, np.zeros(width - len(a), a.dtype)]) for a in (counts, sums))
            counts[: x.shape[1]] += len(x)
            sums[: x.shape[1]] += _exact_sum(x)
        at = range(-1, len(sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([n, *counts.tolist()], pa.int64()), pa.array([Decimal(int(s)) for s in (0, *sums)], _TOTAL)],
            names=["at", "n", "total"],
        )

    parts = rows.select("v").mapInArrow(totals, "at int, n long, total decimal(38,0)")
    # One row a dimension.
    found = {r["at"]: r for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n = found[-1]["n"] if found else 0
    # Dimensions a batch didn't have were zeros there.
    return n, [int(found[j]["total"]) + offset * (n - found[j]["n"]) for j in range(len(found) - 1)]


def _covariance(rows: DataFrame, n: int, sums: list[int], scale: int, offset: int) -> np.ndarray:
    """Covariance with divisor ``n``, each element rounded once."""
    d = len(sums)
    middle = _middles(n, sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            _, x, _ = _numbers(batch, scale, offset)
            total = total + _exact_products(vectors.widened(x, d, offset) - middle)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(p)) for p in total[i, j]], _TOTAL)], names=["i", "j", "dot"]
        )

    out = np.zeros((d, d))
    parts = rows.select("v").mapInArrow(products, "i int, j int, dot decimal(38,0)")
    left = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    # One row a pair of dimensions.
    for r in parts.groupBy("i", "j").agg(F.sum("dot").alias("dot")).collect():
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["dot"]) - left[i] * left[j]) / n**2
    return out


def _middles(n: int, sums: list[int]) -> np.ndarray:
    """The whole number nearest to each mean."""
    return np.array([(2 * s + n) // (2 * n) for s in sums], dtype=float)


def _deviations(y: np.ndarray, n: int, left: list[int]) -> pa.Array:
    """Sums of (n·x - S)², from y = x less its middle; null where a long doesn't hold them."""
    rest = np.array([s % 2**64 for s in left], np.uint64)
    # Unsigned numbers go round at 2**64, so the sum is right whenever the true one fits.
    z = y.astype(np.int64).astype(np.uint64) * np.uint64(n) - rest
    wrapped = (z * z).sum(axis=1, dtype=np.uint64)
    about = ((n * y - np.array(left, float)) ** 2).sum(axis=1)
    out = pa.array(wrapped.astype(np.int64), mask=about >= 2.0**63 * (1 - 1e-9))
    for row in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-9):  # too near to tell from a double
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(y[row], left, strict=True))
        if exact < 2**63:
            out = pa.concat_arrays([out[:row], pa.array([exact], pa.int64()), out[row + 1 :]])
    return out


def whitened(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable row and component: id, ``component`` (from 1, by falling eigenvalue), ``n`` (vectors),
    ``deviation``, ``whitened``, ``explained`` (share of the whole variance) and ``identity_error``."""
    common.bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n, sums = _totals(rows, scale, offset)
    covariance = _covariance(rows, n, sums, scale, offset)
    values, directions = spectrum.leading(covariance, components)
    k, d, middle = len(values), len(sums), _middles(n, sums)
    left = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    fraction = np.array([s / n for s in left])
    project = directions / np.sqrt(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x, _ = _numbers(batch, scale, offset)
            y = vectors.widened(x, d, offset) - middle
            w = (y - fraction) @ project
            ids = batch.column("id").filter(pa.array(good))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, _deviations(y, n, left), lists], names=["id", "deviation", "w"])

    kind = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))]
    )
    stored = storage.materialize(rows.mapInArrow(projected, kind), "whitened")
    explained = F.array(*(F.lit(float(e) / float(np.trace(covariance))) for e in values)).cast("array<double>")
    return stored.select(
        F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("place", "whitened")
    ).select(
        id_col,
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(_identity_error(stored, k)).alias("identity_error"),
    )


def _identity_error(stored: DataFrame, k: int) -> float:
    """The largest element of the difference between the written rows' covariance and the identity."""
    if not k:
        return 0.0
    means = stored.agg(*(F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k))).head()
    centred = [F.get("w", F.lit(i)) - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = stored.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).head()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))
