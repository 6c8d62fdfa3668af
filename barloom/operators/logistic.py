"""Binary logistic regression with an elastic net, trained from passes over the rows.

Spark's own estimator stores all train rows once more, as blocks of doubles for its many steps; blocks beyond the
executors' memory go to their disks. Here a pass reads the rows where they are and a task sends sums as wide as the
features: the loss, its gradient and its second derivatives. The driver takes a proximal Newton step from them, by coordinate
descent over the features. The first step needs the moments of the features alone, later ones a pass each; few are
needed. Objective and minimum are those of Spark's estimator, and so is the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of more features the second derivatives are too large; Spark's estimator takes them.
WIDEST = 1_000
# The driver gets a matrix from each part of the rows, at most so many.
PARTS = 256
# Elements that numpy works on at once.
STEP = 1 << 18
HALVINGS = 40


class Sums(NamedTuple):
    """Of a number of rows: averages of the loss, its gradient and its second derivatives, the intercept last."""

    loss: float
    gradient: np.ndarray
    curvature: np.ndarray


class Moments(NamedTuple):
    """Of rows of features and, last, the label: their number, means and sums of products of the differences from them."""

    n: int
    means: np.ndarray
    products: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n, step = self.n + other.n, other.means - self.means
        products = self.products + other.products + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, self.means + step * (other.n / n), products)


class PassedLogisticRegression(LogisticRegression):
    """Spark's estimator; the rows of a binary model with an elastic net are passed over instead of stored."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        if not self._covered():
            return super()._fit(dataset)
        label, features = F.col(self.getLabelCol()).cast("double"), vector_to_array(self.getFeaturesCol())
        rows = dataset.select(features.alias("x"), label.alias("y")).coalesce(PARTS)
        known = moments(rows)
        # What the estimator rejects, or answers without training, stays with it.
        if known is None or not 0 < known.means[-1] < 1:
            return super()._fit(dataset)
        ridge = self.getRegParam() * (1 - self.getElasticNetParam())
        lasso = self.getRegParam() * self.getElasticNetParam()
        coefficients, intercept = minimized(rows, known, lasso, ridge, self.getTol(), self.getMaxIter())
        kind = "org.apache.spark.ml.classification.LogisticRegressionModel"
        made = self._new_java_obj(kind, self.uid, Vectors.dense(coefficients), float(intercept))
        return self._copyValues(self._create_model(made))

    def _covered(self) -> bool:
        others = ("weightCol", "lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
        plain = self.getFitIntercept() and self.getStandardization() and not any(self.isSet(name) for name in others)
        return plain and self.getFamily() != "multinomial" and self.getRegParam() * (1 - self.getElasticNetParam()) > 0


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Features and labels, some rows at once; None for rows that aren't finite, of one length and labelled 0 or 1."""
    width = None
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        if not len(y):
            continue
        lengths = pc.list_value_length(x)
        width = width or lengths[0].as_py()
        flat, labels = x.flatten(), y.to_numpy(zero_copy_only=False)
        if x.null_count or flat.null_count or not width or width > WIDEST or (lengths.to_numpy() != width).any():
            yield None
            continue
        matrix = flat.to_numpy().reshape(len(labels), width)
        if not np.isfinite(matrix).all() or not np.isin(labels, (0, 1)).all():
            yield None
            continue
        rows = max(1, STEP // width)
        for at in range(0, len(labels), rows):
            yield matrix[at : at + rows], labels[at : at + rows]


def moments(rows: DataFrame) -> Moments | None:
    """The moments of ``x`` and ``y``, put together in the order of the parts; None without rows or with ones that don't fit."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, fits = None, None, True
        for found in _matrices(batches):
            if found is None:
                fits = False
                break
            z = np.column_stack(found)
            # Less a row of their own: the products of a feature with one value are zero.
            first = z[0].copy() if first is None else first
            z -= first
            means = z.mean(axis=0)
            z -= means
            part = Moments(len(z), first + means, z.T @ z)
            total = part if total is None else total.merged(part)
        if not fits:
            yield _sent(-1, 0.0, [], [])
        elif total is not None:
            yield _sent(total.n, 0.0, total.means, total.products)

    parts = _collected(rows, of_part)
    if not parts or any(n < 0 for n, *_ in parts) or len({len(means) for _, _, means, _ in parts}) > 1:
        return None
    total = None
    for n, _, means, products in parts:
        part = Moments(n, means, products.reshape(len(means), -1))
        total = part if total is None else total.merged(part)
    return total


def sums(rows: DataFrame, means: np.ndarray, scale: np.ndarray, weights: np.ndarray, intercept: float) -> Sums:
    """The averages at a point of the features less their means and times ``scale``."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient, curvature = 0, 0.0, np.zeros(len(means) + 1), np.zeros((len(means) + 1,) * 2)
        for x, y in _matrices(batches):
            z = np.column_stack([(x - means) * scale, np.ones(len(x))])
            margin = z @ np.append(weights, intercept)
            chance = np.exp(-np.logaddexp(0, -margin))
            n += len(y)
            loss += float((np.logaddexp(0, margin) - y * margin).sum())
            gradient += (chance - y) @ z
            curvature += z.T @ (z * (chance * (1 - chance))[:, None])
        yield _sent(n, loss, gradient, curvature)

    parts = _collected(rows, of_part)
    n = sum(n for n, *_ in parts)
    loss, gradient, curvature = (sum(part[k] for part in parts) / n for k in (1, 2, 3))
    return Sums(float(loss), gradient, curvature.reshape(len(gradient), -1))


def _sent(n: int, loss: float, vector, matrix) -> pa.RecordBatch:
    lists = [pa.array([np.asarray(values, float).ravel()], pa.list_(pa.float64())) for values in (vector, matrix)]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss], pa.float64()), *lists], names=["n", "loss", "v", "m"])


def _collected(rows: DataFrame, of_part) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """What the parts send, in their order."""
    # Workers find the package where the driver did, unless the job ships it.
    rows.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    sent = rows.mapInArrow(of_part, "n long, loss double, v array<double>, m array<double>").withColumn("part", F.spark_partition_id())
    found = sorted(sent.toArrow().to_pylist(), key=lambda r: r["part"])
    return [(r["n"], r["loss"], np.array(r["v"]), np.array(r["m"])) for r in found]


def stepped(at: Sums, point: np.ndarray, lasso: float, ridge: float) -> np.ndarray:
    """The minimum of the penalized quadratic form around a point, whose last place, the intercept, has no penalty."""
    penalties, squares = np.append(np.full(len(point) - 1, lasso), 0.0), np.append(np.full(len(point) - 1, ridge), 0.0)
    matrix = at.curvature + np.diag(squares)
    slope = at.gradient + squares * point  # of the smooth terms, kept up to date
    found, diagonal = point.copy(), np.diag(matrix)
    moving = np.flatnonzero(diagonal > 0)
    for _ in range(10_000):
        largest = 0.0
        for j in moving:
            wanted = found[j] * diagonal[j] - slope[j]
            value = np.sign(wanted) * max(abs(wanted) - penalties[j], 0.0) / diagonal[j]
            if value != found[j]:
                slope += matrix[j] * (value - found[j])
                largest = max(largest, abs(value - found[j]))
                found[j] = value
        if largest <= 1e-13 * (1 + np.abs(found).max()):
            break
    return found


def minimized(rows: DataFrame, known: Moments, lasso: float, ridge: float, tol: float, steps: int) -> tuple[np.ndarray, float]:
    """Coefficients of the features as they are, and the intercept."""
    n, means, share = known.n, known.means[:-1], known.means[-1]
    spread = np.sqrt(np.diag(known.products)[:-1] / max(n - 1, 1))
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    point = np.append(np.zeros(len(means)), np.log(share / (1 - share)))
    # Without coefficients all rows have one chance, and the moments give the averages.
    curvature = np.zeros((len(point),) * 2)
    curvature[:-1, :-1] = known.products[:-1, :-1] * np.outer(scale, scale) * (share * (1 - share) / n)
    curvature[-1, -1] = share * (1 - share)
    loss = -share * np.log(share) - (1 - share) * np.log(1 - share)
    at = Sums(loss, np.append(-known.products[:-1, -1] * scale / n, 0.0), curvature)

    def penalty(p: np.ndarray) -> float:
        return lasso * np.abs(p[:-1]).sum() + ridge / 2 * (p[:-1] ** 2).sum()

    for _ in range(steps):
        target = stepped(at, point, lasso, ridge)
        step = target - point
        gain = -(at.gradient @ step + ridge * (point[:-1] @ step[:-1]) + lasso * (np.abs(target[:-1]).sum() - np.abs(point[:-1]).sum()))
        if gain <= tol**2 * max(1.0, at.loss):
            point = target
            break
        value, size = at.loss + penalty(point), 1.0
        for _ in range(HALVINGS):
            tried = point + size * step
            there = sums(rows, means, scale, tried[:-1], tried[-1])
            if there.loss + penalty(tried) <= value - 1e-4 * size * gain:
                break
            size /= 2
        else:
            break  # no step is a gain beyond rounding
        point, at = tried, there
    coefficients = point[:-1] * scale
    return coefficients, point[-1] - coefficients @ means
