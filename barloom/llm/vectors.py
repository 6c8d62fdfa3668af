"""Vector columns in Arrow batches as whole-numbered matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest size of a whole number here; a component beyond it fails the job, as sums would not be exact.
LARGEST = 2.0**52


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a vector without null and non-finite elements, those vectors as rows of doubles, and their lengths.

    Shorter vectors are filled up with zeros to the longest of the batch.
    """
    column = column.cast(pa.list_(pa.float64()))
    flat = pc.list_flatten(column)
    flat = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = there & (broken[ends] == broken[ends - lengths])
    width = int(lengths[good].max()) if good.any() else 0
    if good.all() and (lengths == width).all():
        return good, flat.reshape(len(column), width), lengths
    filled = np.zeros((int(good.sum()), width))
    filled[np.arange(width) < lengths[good][:, None]] = flat[np.repeat(good, lengths)]
    return good, filled, lengths[good]


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * value)`` as whole numbers in doubles."""
    out = np.floor(values * float(scale))
    if out.size and not np.abs(out).max() <= LARGEST:
        raise ValueError(f"a vector component is too large to count exactly: {np.abs(out).max()}")
    return out


def widened(matrix: np.ndarray, width: int, filling: float = 0.0) -> np.ndarray:
    """The matrix with columns of ``filling`` added up to ``width``."""
    if matrix.shape[1] == width:
        return matrix
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])), constant_values=filling)
