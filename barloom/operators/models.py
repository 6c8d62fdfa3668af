"""Training and scoring with Spark ML."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import features as fe
from barloom.operators import trees
from barloom.operators.logistic import PassedLogisticRegression

MAX_CATEGORIES = 4
# Boosted trees: every part of the train rows sends its own statistics of all nodes, features and bins at each level.
# At most so many parts send them, so what is shuffled stays the same however many files the rows are read from: the
# first number, and where more cores would be idle as many as there are cores, up to the second.
BOOSTING_PARTS = 8
MOST_BOOSTING_PARTS = 12


class Span(NamedTuple):
    """A walk-forward span: points from ``start``, trained before ``train_end``,
    checked after ``check_start``, labels before ``end`` (None: no end)."""

    start: datetime.date
    train_end: datetime.date
    check_start: datetime.date
    end: datetime.date | None


def classifier(kind: str = "tree"):
    """The classifiers a span can be run with, on indexed labels and features."""
    columns = {"labelCol": "indexedLabel", "featuresCol": "indexedFeatures"}
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=5, maxBins=32, **columns)
    if kind == "forest":
        return RandomForestClassifier(numTrees=2, maxDepth=5, maxBins=32, seed=1, **columns)
    if kind == "logistic":
        return PassedLogisticRegression(maxIter=100000, regParam=0.1, elasticNetParam=0.8, **columns)
    raise ValueError(f"unknown classifier {kind!r}")


def as_vectors(points: DataFrame) -> DataFrame:
    """Array features as a vector column, as Spark ML takes them; vectors are left as they are."""
    if isinstance(points.schema["features"].dataType, VectorUDT):
        return points
    return points.withColumn("features", array_to_vector("features"))


def label_index(indexer: StringIndexerModel, label: int = 1) -> int | None:
    """Place of a label in the probability vector; None when the label never occurs."""
    labels = [int(float(value)) for value in indexer.labelsArray[0]]
    return labels.index(label) if label in labels else None


def fit_span(points: DataFrame, span: Span, kind: str = "tree") -> tuple[PipelineModel, int | None]:
    """Fit label and feature indexes on all points of the span, the classifier on its train rows."""
    within = fe.in_span(points, span.start, span.end)
    labels = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(within)
    vectors = VectorIndexer(
        inputCol="features", outputCol="indexedFeatures", maxCategories=MAX_CATEGORIES
    ).fit(within)
    stages = Pipeline(stages=[labels, vectors, classifier(kind)])
    return stages.fit(fe.train_rows(within, span.train_end)), label_index(labels)


def indexes_of(points: DataFrame) -> DataFrame:
    """What the indexers learn: ``kind, place, value, code``.

    ``label`` rows have each label and its place by frequency; ``feature`` rows each category of
    the features with at most ``MAX_CATEGORIES`` values, zero first, then in ascending order.
    """
    labels = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(points)
    vectors = VectorIndexer(
        inputCol="features", outputCol="indexedFeatures", maxCategories=MAX_CATEGORIES
    ).fit(points)
    rows = [("label", -1, float(x), k) for k, x in enumerate(labels.labelsArray[0])]
    for place, codes in vectors.categoryMaps.items():
        rows += [("feature", int(place), float(value), int(code)) for value, code in codes.items()]
    schema = "kind string, place int, value double, code int"
    return points.sparkSession.createDataFrame(rows, schema)


def keep(model: PipelineModel, path: str) -> None:
    """Store a span's model, replacing what is there."""
    model.write().overwrite().save(path)


def kept(path: str) -> tuple[PipelineModel, int | None]:
    """A stored model and the place of label 1, as ``fit_span`` returned them."""
    model = PipelineModel.load(path)
    return model, label_index(model.stages[0])


def explained(scored: DataFrame, model: PipelineModel, index: int | None) -> DataFrame:
    """Rows that a span's model has transformed, with ``node_prob``: ``prob`` computed from its nodes or coefficients alone."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        rows = trees.logistic(scored, last, "indexedFeatures", "_shares")
    else:
        rows = trees.voted(scored, trees.node_table(scored.sparkSession, last), "indexedFeatures", "_shares")
    prob = F.lit(0.0) if index is None else F.get("_shares", F.lit(index))
    return rows.withColumn("node_prob", prob).drop("_shares")


def score_span(
    points: DataFrame, span: Span, model: PipelineModel, index: int | None, explain: bool = False
) -> DataFrame:
    """Check rows with ``prob``, the probability of label 1, and ``predicted_label``; vectors as text.

    With ``explain`` also ``node_prob``, the same from the model as data.
    """
    checked = fe.check_rows(fe.in_span(points, span.start, span.end), span.check_start)
    return _scored(checked, model, index, explain)


def score_date(points: DataFrame, date: datetime.date, model: PipelineModel, index: int | None) -> DataFrame:
    """The points anchored at a date, labelled or not, as ``score_span`` gives them."""
    return _scored(points.where(F.col("date2") == F.lit(date)), model, index)


def _scored(rows: DataFrame, model: PipelineModel, index: int | None, explain: bool = False) -> DataFrame:
    scored = model.transform(rows)
    if explain:
        scored = explained(scored, model, index)
    prob = F.lit(0.0) if index is None else F.get(vector_to_array("probability"), F.lit(index))
    named = F.lit(None).cast("double") if index is None else F.when(F.col("prediction") == index, 1.0).otherwise(0.0)
    return scored.withColumn("prob", prob).withColumns(
        {
            "predicted_label": named,
            "features": F.col("features").cast("string"),
            "indexedFeatures": F.col("indexedFeatures").cast("string"),
            "probability": F.col("probability").cast("string"),
        }
    ).drop("rawPrediction")


def classify(points: DataFrame, span: Span, kind: str = "tree") -> DataFrame:
    """Train and score one span. ``points`` is read several times: pass a stored table."""
    vectors = as_vectors(points)
    model, index = fit_span(vectors, span, kind)
    return score_span(vectors, span, model, index)


def regress(
    train: DataFrame, check: DataFrame, max_iter: int = 50, max_depth: int = 10
) -> DataFrame:
    """Gradient-boosted trees: ``check`` with a ``prediction`` column."""
    return fit_regression(train, max_iter, max_depth).transform(as_vectors(check))


def boosting_parts(cores: int) -> int:
    return max(BOOSTING_PARTS, min(cores, MOST_BOOSTING_PARTS))


def fit_regression(
    train: DataFrame, max_iter: int = 50, max_depth: int = 10, parts: int | None = None
) -> GBTRegressionModel:
    """Gradient-boosted trees over all of ``train``, read in at most ``parts`` tasks (by default as ``boosting_parts`` says).

    The parts are put together without a shuffle: rows keep their order, so a part that is computed again is the same.
    """
    parts = parts or boosting_parts(train.sparkSession.sparkContext.defaultParallelism)
    rows = as_vectors(train).coalesce(parts)
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, seed=1).fit(rows)


def buy_and_hold(points: DataFrame, spans: list[Span]) -> DataFrame:
    """The baseline: every labelled check row of each span is predicted with certainty.

    ``points`` are forward labels with -1 for unlabelled rows. A point is repeated for each
    span it falls in, so the points are computed once.
    """
    labelled = points.where((F.col("label") != -1) & (F.col("is_labeled") == 1))

    def falls_in(span: Span) -> Column:
        within = (F.col("date1") >= F.lit(span.start)) & (F.col("date2") > F.lit(span.check_start))
        return within if span.end is None else within & (F.col("date3") < F.lit(span.end))

    hits = F.array(*(F.when(falls_in(span), F.lit(1.0)) for span in spans))
    return labelled.withColumn("prob", F.explode(F.filter(hits, lambda x: x.isNotNull())))
