"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of D in LDLᵀ = V - s·I say how many eigenvalues lie above s (Sylvester's law of inertia). Halving
intervals by these counts isolates the k-th largest eigenvalue; Rayleigh quotient iteration, started in the interval,
converges cubically; counts just above and just below the value certify that it is the k-th.
"""

from __future__ import annotations

import numpy as np

_GROWTH = (1 + 17**0.5) / 8
_EPS = np.finfo(float).eps


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are larger than ``shift``: the positive ones of D in LDLᵀ.

    Pivots are single elements or blocks of two, chosen so that elements can't grow out of bounds (partial
    pivoting after Bunch and Kaufman).
    """
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], :] = a[[j, i], :]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max() if len(below) else 0.0
        single = True
        if largest > 0 and abs(a[k, k]) < _GROWTH * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest >= _GROWTH * largest**2:
                pass
            elif abs(a[r, r]) >= _GROWTH * widest:
                swap(k, r)
            else:
                swap(k + 1, r)
                single = False
        if single:
            pivot = a[k, k]
            positive += int(pivot > 0)
            if pivot != 0:
                column = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
            k += 1
        else:
            block = a[k : k + 2, k : k + 2].copy()
            # Such a block has a negative determinant, so one eigenvalue of each sign.
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if determinant < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            columns = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(block, columns.T)
            k += 2
    return positive


def _orthogonal(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``found``, of length one; twice is enough."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _solved(a: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """Solution of (a - shift·I) x = v; a shift that is an eigenvalue to the last digit is moved by one digit."""
    eye = np.eye(len(a))
    try:
        x = np.linalg.solve(a - shift * eye, v)
        if np.isfinite(x).all():
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.solve(a - (shift + 4 * _EPS * scale) * eye, v)


def leading(matrix: np.ndarray, wanted: int, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues, falling, and their unit eigenvectors as columns.

    Values that aren't above ``tolerance`` of the matrix's size count as zero and are left out. The largest
    element of a vector is positive. Vectors of a multiple eigenvalue are some orthonormal basis of its space.
    """
    a = (matrix + matrix.T) / 2
    d = len(a)
    scale = float(np.abs(a).sum(axis=1).max()) if d else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((d, 0))
    floor = tolerance * scale
    wanted = min(wanted, inertia_above(a, floor))
    near = 8 * d * _EPS * scale
    counts: dict[float, int] = {floor: inertia_above(a, floor), scale * (1 + 1e-9): 0}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = inertia_above(a, s)
        return counts[s]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    random = np.random.default_rng(1)
    for k in range(1, wanted + 1):
        # The tightest known bounds of the k-th largest value, from all counts so far.
        low = max(s for s, n in counts.items() if n >= k)
        high = min(s for s, n in counts.items() if n < k)
        value, vector = None, None
        while value is None:
            alone = above(low) == k and above(high) == k - 1
            if alone or high - low <= near:
                value, vector = _iterated(a, low, high, scale, near, vectors, random)
                # Counts certify the number: k values above the lower side, k - 1 above the upper one.
                if value is not None and high - low > near and not (above(value - near) >= k > above(value + near)):
                    value = None
                if value is None and high - low <= near:
                    raise ArithmeticError("an eigenvalue could not be certified")
            if value is None:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
        values.append(value)
        vectors.append(vector if vector[np.abs(vector).argmax()] > 0 else -vector)
    return np.array(values), np.array(vectors).T.reshape(d, wanted)


def _iterated(
    a: np.ndarray, low: float, high: float, scale: float, near: float, found: list[np.ndarray], random: np.random.Generator
) -> tuple[float | None, np.ndarray | None]:
    """Rayleigh quotient iteration from the middle of an interval; none if it leaves the interval."""
    # Vectors of values that differ clearly are orthogonal by themselves; the projection keeps those of a cluster apart.
    v = _orthogonal(random.standard_normal(len(a)), found)
    shift, best = (low + high) / 2, np.inf
    for step in range(60):
        v = _orthogonal(_solved(a, shift, v, scale), found)
        value = float(v @ (a @ v))
        residual = float(np.linalg.norm(a @ v - value * v))
        if step >= 2 and (residual <= _EPS * scale or (residual <= near and residual >= best / 2)):
            return (value, v) if low - near <= value <= high + near else (None, None)
        # Two steps with the fixed shift first; then the quotient, while it stays in the interval.
        if step >= 1:
            if not low - near <= value <= high + near:
                return None, None
            shift = value
        best = min(best, residual)
    return None, None
