"""Logistic regression from passes over the rows, against Spark's estimator."""

from __future__ import annotations

import random
from math import exp, inf

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import logistic, models

OPTIONS = {"featuresCol": "features", "labelCol": "label", "maxIter": 1000}


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        a, b, c = rng.gauss(0, 1), rng.gauss(1000, 0.1), rng.gauss(-3, 5)
        x = [a, b, c, 0.5 * c + rng.gauss(0, 1), 7.1, float(rng.randrange(2)), rng.gauss(0, 30), 0.0]
        rows.append((k, x, float(rng.random() < 1 / (1 + exp(1 - 2 * a + 10 * (b - 1000) - 0.5 * c)))))
    rows.sort(key=lambda r: r[1][0])  # the parts differ in their means
    df = spark.createDataFrame(rows, "id int, f array<double>, label double").withColumn("features", array_to_vector("f"))
    return storage.materialize(df.repartitionByRange(5, "id"), "points")


@pytest.fixture()
def stored(monkeypatch):
    """The calls of Spark's estimator, which stores the rows."""
    calls, real = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: calls.append(rows) or real(self, rows))
    return calls


@pytest.mark.parametrize("penalty", [(0.1, 0.8), (0.01, 0.5), (0.01, 0.0), (1.0, 0.9)])
def test_the_minimum_is_that_of_sparks_estimator(points, stored, penalty):
    options = OPTIONS | dict(zip(("regParam", "elasticNetParam"), penalty, strict=True))
    model = logistic.PassedLogisticRegression(**options).fit(points)
    assert not stored
    expected = LogisticRegression(tol=1e-13, **options).fit(points)
    assert type(model) is LogisticRegressionModel and (model.numFeatures, model.numClasses) == (8, 2)
    found, wanted = model.coefficients.toArray(), expected.coefficients.toArray()
    assert found == pytest.approx(wanted, rel=1e-4, abs=1e-5)
    assert ((found == 0) == (np.abs(wanted) < 1e-9)).all() or penalty[1] == 0
    both = expected.transform(model.transform(points).select("features", F.col("probability").alias("p")))
    for r in both.select(vector_to_array("p").alias("p"), vector_to_array("probability").alias("q")).collect():
        assert r["p"] == pytest.approx(r["q"], abs=1e-4)


def test_a_span_is_trained_without_a_stored_copy(points, stored, tmp_path):
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id"))
    dated = points.withColumns({"date1": day, "date2": day, "date3": day, "is_labeled": F.lit(1), "label": F.col("label").cast("int")}).drop("f")
    ends = dated.agg(F.min("date1"), F.max("date3")).first()
    model, index = models.fit_span(dated, models.Span(ends[0], ends[1], ends[0], None), "logistic")
    assert not stored and index is not None
    models.keep(model, str(tmp_path / "kept"))
    again, _ = models.kept(str(tmp_path / "kept"))
    rows = [m.transform(dated).orderBy("id").select("probability").collect() for m in (model, again)]
    assert rows[0] == rows[1] and len({r[0][0] for r in rows[0]}) > 100


def test_rows_without_effect_end_after_one_pass(spark, monkeypatch):
    passes, real = [], logistic._collected
    monkeypatch.setattr(logistic, "_collected", lambda *a: passes.append(1) or real(*a))
    rng = random.Random(5)
    rows = [([rng.random(), rng.random()], float(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "f array<double>, label double").withColumn("features", array_to_vector("f"))
    model = logistic.PassedLogisticRegression(regParam=1.0, elasticNetParam=0.9, **OPTIONS).fit(df)
    assert len(passes) == 1 and list(model.coefficients) == [0, 0] and model.intercept == pytest.approx(np.log(0.5))


@pytest.mark.parametrize("labels", [[1.0], [0.0], [0.0, 1.0, 2.0]])
def test_other_labels_are_left_to_sparks_estimator(spark, stored, labels):
    rows = [([float(k % 7), float(k % 5)], labels[k % len(labels)]) for k in range(60)]
    df = spark.createDataFrame(rows, "f array<double>, label double").withColumn("features", array_to_vector("f"))
    options = OPTIONS | {"regParam": 0.1, "elasticNetParam": 0.5}
    model = logistic.PassedLogisticRegression(**options).fit(df)
    assert len(stored) == 1
    expected = LogisticRegression(**options).fit(df)
    assert model.interceptVector == expected.interceptVector
    if len(labels) == 1:
        assert model.intercept == (inf if labels == [1.0] else -inf)


def test_wide_rows_unweighted_lasso_and_missing_values(spark, points, stored, monkeypatch):
    monkeypatch.setattr(logistic, "WIDEST", 7)
    logistic.PassedLogisticRegression(regParam=0.1, elasticNetParam=0.5, **OPTIONS).fit(points)
    monkeypatch.undo()
    assert logistic.moments(points.select(F.col("f").alias("x"), F.col("label").alias("y")).where("false")) is None
    lasso = logistic.PassedLogisticRegression(regParam=0.1, elasticNetParam=1.0, **OPTIONS)
    assert not lasso._covered() and lasso.setElasticNetParam(0.5)._covered()
    assert not lasso.setWeightCol("id")._covered()
    for broken in ([1.0], [1.0, None], [1.0, float("nan")], None):
        rows = spark.createDataFrame([([1.0, 2.0], 1.0), (broken, 0.0)], "x array<double>, y double").coalesce(1)
        assert logistic.moments(rows) is None


def test_moments_of_parts(points):
    rows = points.select(F.col("f").alias("x"), F.col("label").alias("y"))
    z = np.array([[*r["x"], r["y"]] for r in rows.collect()])
    for parts in (rows, rows.coalesce(1), rows.repartition(9)):
        known = logistic.moments(parts)
        assert known.n == 1200 and known.means == pytest.approx(z.mean(axis=0), rel=1e-12)
        assert known.products == pytest.approx((z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rel=1e-8, abs=1e-6)
        assert not known.products[4].any()  # a feature with one value
