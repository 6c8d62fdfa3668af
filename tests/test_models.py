from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from helpers import by_key, day, frame, random_walk
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import evaluate, features, indexes, models, similarity
from barloom.operators.evaluate import Cell
from barloom.operators.models import Span


def labelled(spark, n=120, symbols="ABCD", coach=2):
    bars = frame(spark, [r for s in symbols for r in random_walk(s, n)])
    points = features.forward_labels(bars, 5, coach, unlabeled=1)
    steps = F.array(F.col("close") / F.col("open"), F.col("high") / F.col("low"), F.lit(1.0))
    return points.withColumn("features", steps)


SPAN = Span(day("1990-01-01"), day("1990-03-01"), day("1990-03-01"), None)


@pytest.mark.parametrize("kind", ["tree", "forest", "logistic"])
def test_classifiers_score_the_check_rows(spark, kind):
    points = labelled(spark)
    scored = models.classify(points, SPAN, kind)
    rows = scored.collect()
    assert len(rows) == points.where(F.col("date2") > F.lit(SPAN.check_start)).count()
    assert all(0 <= r["prob"] <= 1 for r in rows)
    assert {"features", "indexedFeatures", "probability"} <= {
        f.name for f in scored.schema.fields if f.dataType.simpleString() == "string"
    }
    assert "rawPrediction" not in scored.columns
    assert any(r["is_labeled"] == 0 for r in rows)


def test_probability_is_that_of_label_one(spark):
    rows = [
        (day("1990-01-01"), day(f"1990-01-{d:02d}"), day("1990-01-31"), 1, int(d > 9), [float(d > 9)])
        for d in range(2, 30)
    ]
    points = spark.createDataFrame(
        rows, "date1 date, date2 date, date3 date, is_labeled int, label int, features array<double>"
    )
    span = Span(day("1989-01-01"), day("1991-01-01"), day("1990-01-01"), None)
    for r in models.classify(points, span).collect():
        assert r["prob"] == float(r["label"])


def test_unknown_classifier():
    with pytest.raises(ValueError):
        models.classifier("oracle")


def test_regression_beats_the_naive_prediction(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        x = [rng.uniform(0.9, 1.1), rng.uniform(0.9, 1.1)]
        rows.append((x[0] * 2 - 1, x))
    points = spark.createDataFrame(rows, "label double, features array<double>")
    scored = models.regress(points, points, max_iter=5, max_depth=3)
    errors = evaluate.squared_errors(scored).first()
    assert errors["mse"] < errors["naive_mse"] / 2


def test_boosted_trees_read_all_rows_in_a_bounded_number_of_parts(spark, monkeypatch):
    real, seen = models.GBTRegressor.fit, []
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: seen.append(rows) or real(self, rows))
    rng = random.Random(2)
    rows = [(k, x[0] * x[1], x) for k in range(300) for x in [[rng.uniform(0.9, 1.1), rng.uniform(0.9, 1.1)]]]
    points = spark.createDataFrame(rows, "id int, label double, features array<double>")
    scores = []
    for parts in (3, 40):
        model = models.fit_regression(points.repartition(parts, "id"), max_iter=3, max_depth=3)
        scored = model.transform(models.as_vectors(points)).orderBy("id").select("prediction")
        scores.append([r["prediction"] for r in scored.collect()])
    assert [rows.rdd.getNumPartitions() for rows in seen] == [3, models.BOOSTING_PARTS]
    assert [rows.count() for rows in seen] == [300, 300]
    assert scores[1] == pytest.approx(scores[0])


def test_vectors_are_left_alone(spark):
    points = labelled(spark, n=20).withColumn("features", array_to_vector("features"))
    assert models.as_vectors(points) is points


def test_buy_and_hold_takes_labelled_check_rows(spark):
    bars = frame(spark, random_walk("A", 60))
    points = features.forward_labels(bars, 5, 4, unlabeled=-1)
    spans = [
        Span(day("1990-01-01"), day("1990-02-01"), day("1990-02-01"), day("1990-02-20")),
        Span(day("1990-01-01"), day("1990-02-10"), day("1990-02-10"), day("1999-01-01")),
    ]
    rows = models.buy_and_hold(points, spans).collect()
    assert {r["prob"] for r in rows} == {1.0} and {r["is_labeled"] for r in rows} == {1}
    first = [r for r in rows if r["date2"] <= day("1990-02-10")]
    assert min(r["date2"] for r in first) == day("1990-02-02")
    assert len(rows) == 14 + 15


@pytest.fixture()
def predictions(spark):
    bars = frame(spark, [r for s in "ABC" for r in random_walk(s, 100)])
    relative = bars.where(F.dayofmonth("date") != 5)
    benchmark = frame(spark, random_walk("SPX", 100))
    points = features.forward_labels(relative, 5, 3, unlabeled=-1)
    scored = points.withColumn("prob", (F.dayofyear("date2") % 10) / 10.0)
    return bars, relative, benchmark, scored


def test_enrichment_looks_up_both_dates(spark, predictions):
    bars, relative, benchmark, scored = predictions
    breadth = indexes.breadth_over(relative)
    found = evaluate.enrich(scored, bars.where("symbol <> 'C'"), relative, benchmark, breadth)
    rows = found.collect()
    assert len(rows) == scored.where("is_labeled = 1").count()
    closes, opens = by_key(bars), by_key(benchmark)
    days = {r["date"]: r for r in breadth.collect()}
    for r in rows:
        at2, at3 = (r["symbol"], r["date2"]), (r["symbol"], r["date3"])
        missing = r["symbol"] == "C"
        assert r["close1"] == (None if missing else closes[at2]["adjclose"])
        assert r["close2"] == (None if missing else closes[at3]["adjclose"])
        assert r["relclose2"] == closes[at3]["close"]
        assert r["spxopen1"] == opens[("SPX", r["date2"])]["open"]
        assert r["num_pos"] == days[r["date3"]]["pos"]
    plain = evaluate.with_prices(scored, bars, benchmark)
    assert plain.count() == scored.count()
    assert plain.where("date3 is null and close2 is null and close1 is not null").count() > 0


def test_precision_sweep(spark, predictions):
    bars, relative, benchmark, scored = predictions
    found = evaluate.enrich(scored, bars, relative, benchmark, indexes.breadth_over(relative))
    cells = [
        Cell(0.5, day("1990-01-01"), day("1991-01-01")),
        Cell(1.0, day("1990-01-01"), day("1991-01-01")),
        Cell(0.3, day("1990-02-01"), day("1990-03-01")),
        Cell(0.3, day("2000-02-01"), day("2000-03-01")),
    ]
    rows = found.collect()
    swept = {(r["threshold"], r["start"]): r for r in evaluate.precision_sweep(found, cells).collect()}
    assert len(swept) == 4
    for cell in cells:
        period = [r for r in rows if cell.start <= r["date2"] < cell.end]
        chosen = [r for r in period if r["prob"] >= cell.threshold]
        row = swept[(cell.threshold, cell.start)]
        right = sum(r["act_diff"] >= 1 for r in chosen)
        assert (row["acc"], row["all"]) == (right, len(chosen))
        assert row["acc2"] == sum(r["close2"] / r["close1"] >= 1 for r in chosen)
        if chosen:
            assert row["precision"] == pytest.approx(right / len(chosen))
            base = sum(r["act_diff"] >= 1 for r in period) / len(period)
            assert row["base_precision"] == pytest.approx(base)
        else:
            assert (row["precision"], row["base_precision"]) == (0.0, 0.0)


def test_label_violations(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 1.0), (0, 2.0, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "label int, relclose1 double, relclose2 double")
    assert evaluate.label_violations(df).first()["violations"] == 1


def test_best_and_worst(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 3.0)], "symbol string, p double")
    assert [r[0] for r in evaluate.top_predictions(df, "p", 3, "symbol").collect()] == ["b", "d", "c"]
    assert [r[0] for r in evaluate.bottom_predictions(df, "p", 2, "symbol").collect()] == ["a", "c"]


def test_open_predictions_of_a_date(spark, predictions):
    scored = predictions[3]
    last = scored.agg(F.max("date2")).first()[0]
    rows = evaluate.open_predictions(scored, last).collect()
    assert len(rows) == 3 and {r["is_labeled"] for r in rows} == {0}


def test_column_similarities(spark):
    rows = [([1.0, 0.0, 2.0, 0.0, 0.0, 1.0],), ([0.0, 0.0, 4.0, 2.0, 0.0, 0.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(3)
    found = {(r["i"], r["j"]): r["similarity"] for r in similarity.column_similarities(df, "v").collect()}
    x = np.array([rows[0][0], rows[1][0]])
    norms = np.linalg.norm(x, axis=0)
    expected = {
        (i, j): x[:, i] @ x[:, j] / norms[i] / norms[j]
        for i in range(6)
        for j in range(i + 1, 6)
        if x[:, i] @ x[:, j]
    }
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(v) for k, v in expected.items())


@pytest.mark.parametrize("tile", [1, 7, 16, 64])
def test_tiles_equal_the_whole_matrix(spark, tile):
    rng = np.random.default_rng(4)
    values = rng.integers(-3, 4, (90, 50)).astype(float)
    values[:, 7] = 0
    df = spark.createDataFrame([(row,) for row in values.tolist()] + [(None,)], "v array<double>").repartition(3)

    def found(**options):
        return {(r["i"], r["j"]): r["similarity"] for r in similarity.column_similarities(df, "v", **options).collect()}

    whole, tiled = found(), found(dense=10, tile=tile, tile_rows=20)
    assert whole.keys() == tiled.keys() and len(whole) > 1000 and all(7 not in k for k in whole)
    assert all(tiled[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)


def test_ten_thousand_components(spark):
    """Sparse vectors, so that few products aren't zero; a matrix of all products would take 800 MB a task."""
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        v = [0.0] * 10_000
        for k in rng.sample(range(10_000), 8):
            v[k] = rng.uniform(1, 2)
        rows.append(v)
    df = spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(2)
    found = {(r["i"], r["j"]): r["similarity"] for r in similarity.column_similarities(df, "v").collect()}
    pairs = {(i, j) for v in rows for i in (k for k, x in enumerate(v) if x) for j in (k for k, x in enumerate(v) if x) if i < j}
    assert found.keys() == pairs
    i, j = next(iter(pairs))
    dot, a, b = (sum(v[x] * v[y] for v in rows) for x, y in ((i, j), (i, i), (j, j)))
    assert found[i, j] == pytest.approx(dot / (a * b) ** 0.5)


def test_vectors_of_several_lengths_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").coalesce(1)
    for dense in (10, 1):
        with pytest.raises(Exception, match="one length"):
            similarity.column_similarities(df, "v", dense=dense).collect()


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([None, float("nan"), 0.0, 0.5, 1.0, rng.random(), rng.random()]), day("1995-01-01") + datetime.timedelta(days=rng.randrange(900)),
         rng.uniform(0.5, 1.5), rng.choice([0.0, None, 1.0]), rng.uniform(0.5, 1.5))
        for _ in range(2000)
    ]
    rows += [(0.5, None, 1.0, 1.0, 1.0), (0.5, day("2099-01-01"), 1.0, 1.0, 1.0)]
    return storage.materialize(spark.createDataFrame(rows, "prob double, date2 date, act_diff double, close1 double, close2 double"), "many")


def test_grid_equals_sweep(many):
    rng = random.Random(2)
    edges = [day("1994-06-01") + datetime.timedelta(days=97 * k) for k in range(14)]
    cells = [Cell(rng.choice([0.0, 0.25, 0.5, 1.0, 2.0]), *rng.sample(edges, 2)) for _ in range(60)]
    cells += [cells[0], Cell(0.5, edges[3], edges[3]), Cell(0.5, edges[0], edges[-1]), Cell(-1.0, edges[0], edges[-1])]

    def found(run):
        return {(r["threshold"], r["start"], r["end"]): r.asDict() for r in run(many, cells).collect()}

    grid, sweep = found(evaluate.precision_grid), found(evaluate.precision_sweep)
    assert grid == sweep and len(grid) == len(set(cells)) and sum(r["all"] for r in grid.values()) > 1000
    assert evaluate.precision_grid(many, []).count() == 0
    assert {r["all"] for r in evaluate.precision_grid(many.limit(0), cells).collect()} == {0}


def test_ten_thousand_cells_cost_one_aggregate(many):
    starts = [day("1995-01-01") + datetime.timedelta(days=9 * k) for k in range(100)]
    cells = [Cell(t / 100, a, a + datetime.timedelta(days=30)) for t in range(100) for a in starts]
    grid = evaluate.precision_grid(many, cells)
    assert grid.count() == 10_000
    text = grid._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("prob#") and text.count("Relation [prob") == 1
    row = grid.where("threshold = 0.37").orderBy("start").collect()[40]
    kept = many.where(F.col("date2").between(row["start"], row["end"] - datetime.timedelta(days=1)) & (F.col("prob") >= row["threshold"]))
    assert row["all"] == kept.count() > 0


def test_boosting_uses_more_cores_up_to_a_bound(spark, monkeypatch):
    assert [models.boosting_parts(cores) for cores in (1, 8, 10, 12, 500)] == [8, 8, 10, 12, models.MOST_BOOSTING_PARTS]
    real, seen = models.GBTRegressor.fit, []
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or real(self, rows))
    monkeypatch.setattr(models, "boosting_parts", lambda cores: cores + 6)
    points = spark.createDataFrame([(k / 40, [k / 40, 1.0]) for k in range(40)], "label double, features array<double>")
    models.fit_regression(points.repartition(30), max_iter=1, max_depth=2)
    assert seen == [spark.sparkContext.defaultParallelism + 6]
