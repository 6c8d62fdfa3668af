"""Cosine similarity of vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many components a task adds up their whole matrix of products; beyond, the matrix is cut into tiles.
DENSE_COMPONENTS = 1024
#: Components on a side of a tile.
TILE = 2048
#: About so many rows are added up in a tile before its products are sent on.
TILE_ROWS = 1 << 16
#: Lines of a matrix of products that become rows at once.
STRIP = 128


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows."""
    column = column.cast(pa.list_(pa.float64()))
    width = len(column[0]) if len(column) else 0
    flat = column.flatten()
    if flat.null_count or not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("vectors need one length and no NULL element")
    return flat.to_numpy().reshape(len(column), width)


def _entries(dots: np.ndarray, row: int, column: int, upper: bool) -> Iterator[pa.RecordBatch]:
    """A block of products as rows, some lines of it at once; of a block on the diagonal its upper half."""
    for at in range(0, len(dots), STRIP):
        part = dots[at : at + STRIP]
        i, j = np.nonzero(np.triu(part, at) if upper else part)
        columns = [pa.array(i + at + row, pa.int32()), pa.array(j + column, pa.int32()), pa.array(part[i, j])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "dot"])


def _dense(rows: DataFrame) -> DataFrame:
    """Products of components, one matrix a task."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            matrix = _matrix(batch.column("v"))
            if len(matrix):
                if total is not None and len(total) != matrix.shape[1]:
                    raise ValueError("vectors need one length and no NULL element")
                total = matrix.T @ matrix + (0 if total is None else total)
        if total is not None:
            yield from _entries(total, 0, 0, upper=True)

    return rows.mapInArrow(products, "i int, j int, dot double")


def _tiled(rows: DataFrame, width: int, tile: int, deals: int) -> DataFrame:
    """Products of components, one tile of the matrix at a time.

    Vectors are cut into slices of ``tile`` components; a pair of slices meets in the task of its tile, which holds
    the tile's products and one batch. The rows of a tile are dealt out ``deals`` times.
    """
    starts = list(range(0, width, tile))
    pairs = [(a, b) for k, a in enumerate(starts) for b in starts[k:]]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() % deals
        for batch in batches:
            matrix = _matrix(batch.column("v"))
            if len(matrix) and matrix.shape[1] != width:
                raise ValueError("vectors need one length and no NULL element")
            for a, b in pairs if len(matrix) else []:
                sides = [np.ascontiguousarray(matrix[:, x : x + tile]).tobytes() for x in (a, b)]
                columns = [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([deal], pa.int32()), pa.array([len(matrix)], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x]) for x in sides)], names=["a", "b", "deal", "n", "x", "y"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for a, b, deal, n, x, y in zip(*(batch.column(c) for c in ("a", "b", "deal", "n", "x", "y")), strict=True):
                key, n = (a.as_py(), b.as_py(), deal.as_py()), n.as_py()
                if key != at:
                    if at is not None:
                        yield from _entries(total, at[0], at[1], upper=at[0] == at[1])
                    at, total = key, 0
                left, right = (np.frombuffer(s.as_buffer()).reshape(n, -1) for s in (x, y))
                total = total + left.T @ right
        if at is not None:
            yield from _entries(total, at[0], at[1], upper=at[0] == at[1])

    cut = rows.mapInArrow(slices, "a int, b int, deal int, n int, x binary, y binary")
    dealt = cut.repartition("a", "b", "deal").sortWithinPartitions("a", "b", "deal")
    return dealt.mapInArrow(products, "i int, j int, dot double")


def column_similarities(
    vectors: DataFrame, column: str, dense: int = DENSE_COMPONENTS, tile: int = TILE, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Cosine similarity of the components of an array column: ``i < j, similarity``.

    Products are added up in matrices before the shuffle, never as a row a pair of components and vector: up to
    ``dense`` components one matrix a task, beyond that in tiles, so that no task holds more than a tile
    however long the vectors are. Components that are zero everywhere have no similarities; neither do
    orthogonal ones. Vectors must have one length and no NULL element; NULL vectors are left out.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).head()
    width, deals = known["width"] or 0, max(1, known["n"] // tile_rows)
    products = _dense(rows) if width <= dense else _tiled(rows, width, tile, deals)
    dots = products.groupBy("i", "j").agg(F.sum("dot").alias("dot"))
    # One row per component.
    norms = dots.where(F.col("i") == F.col("j")).select("i", F.sqrt("dot").alias("norm"))
    of_i = norms.select("i", F.col("norm").alias("norm_i"))
    of_j = norms.select(F.col("i").alias("j"), F.col("norm").alias("norm_j"))
    return (
        dots.where((F.col("i") < F.col("j")) & (F.col("dot") != 0))
        .join(F.broadcast(of_i), "i")
        .join(F.broadcast(of_j), "j")
        .select("i", "j", (F.col("dot") / (F.col("norm_i") * F.col("norm_j"))).alias("similarity"))
    )
