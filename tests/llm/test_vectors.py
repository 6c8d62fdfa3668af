"""Hard negatives and whitening against plain computations, spectrum slicing against dense eigenvalues."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives, spectrum, whiten

ROWS = "vec_id long, label int, embedding array<float>"


def random_rows(n, d, labels, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    values = (rng.standard_normal((n, d)) * spread / d**0.5).astype(np.float32)
    return [(k, int(rng.integers(labels)), values[k].tolist()) for k in range(n)]


AWKWARD = [
    (1001, None, [0.5] * 8), (1002, 1, None), (1003, 1, [0.5] * 7 + [None]), (1004, 1, [float("nan")] * 8),
    (1050, 1, [float("inf")] * 8), (None, 1, [0.5] * 8), (1006, 2, [0.5] * 3), (1007, 2, []), (1100, 2, [0.0] * 8),
]


# --- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    used = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used[i] = min(used.get(i, (label, v)), (label, v))
    numbers = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in used.items()}
    out = []
    for a, (label, v) in numbers.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in numbers.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fitting = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fitting, 1)]
    return sorted(out)


def mined(spark, rows, every=10, parts=3, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    names = ("id", "v", "slot", "score", "anchor_id", "negative_id", "is_anchor", "limits", "low", "high")
    df = df.withColumns({name: F.lit("extra") for name in names})
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_negatives_equal_a_plain_search(spark):
    rows = random_rows(300, 8, 4) + AWKWARD
    expected = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(expected) > 200
    assert mined(spark, rows) == expected


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = random_rows(200, 6, 3, seed=4)
    expected = plain_negatives(rows, lambda i: i % 10 == 0, 4, 2, 30, 80)
    for name, value in [("ROW_NUMBERS", 60), ("SCORES", 16), ("READ_ANCHORS", 3), ("FILE_ANCHORS", 5)]:
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows, parts=2, positives=4, negatives=2, lowest=30, highest=80) == expected


def test_ties_go_to_smaller_ids_and_hot_copies_are_whole(spark):
    v, w = [0.5, 0.5, 0.5], [0.4, 0.5, 0.5]
    rows = [(k, k % 2, v) for k in range(200)] + [(200 + k, k % 2, w) for k in range(100)] + random_rows(5, 3, 2, seed=1)
    rows = list({r[0]: r for r in rows}.values())
    expected = plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == expected and len({r[0] for r in expected}) == 29


def test_repeated_rows_and_ids(spark):
    rows = random_rows(80, 4, 2, seed=7)
    rows += rows[:30] + [(10, 1 - rows[10][1], rows[11][2]), (20, rows[20][1], rows[5][2])]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_wide_scores_stay_exact(spark):
    rng = random.Random(5)
    for spread in (2.0**8, 2.0**20):
        rows = [(k, k % 3, [rng.uniform(-spread, spread) for _ in range(4)]) for k in range(60)]
        rows = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in rows]
        assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="fit a long"):
        mined(spark, [(0, 0, [2.0**30] * 4), (1, 0, [2.0**30] * 4)])


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(10, 0, [1.0]), (11, 1, [0.7])]) == []
    assert mined(spark, [(10, 0, [1.0]), (11, 0, [-1.0]), (12, 1, [-0.7])]) == []


# --- spectrum slicing


def matrices():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    yield from (x.T @ x for x in (rng.standard_normal((50, d)) for d in (1, 2, 5, 40)))
    yield from (x.T @ x for x in (rng.integers(-2, 3, (int(rng.integers(1, 12)), int(rng.integers(1, 10)))).astype(float) for _ in range(60)))
    yield np.eye(9) * 3
    yield np.ones((6, 6))
    yield np.diag([5, 5, 5, 4, 4, 1e-3, 1e-9, 0])
    yield q @ np.diag(np.r_[10, 10 - 1e-9, 10 - 2e-9, 9, 9, np.linspace(1, 0.1, 35)]) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(40)) @ q.T


@pytest.mark.parametrize("a", list(matrices()))
def test_leading_pairs(a):
    values, vectors = spectrum.leading(a, 8)
    dense, scale = np.linalg.eigvalsh(a)[::-1], max(np.abs(a).sum(axis=1).max(), 1e-300)
    n = len(values)
    assert n == min(8, int((dense > 1e-13 * scale).sum()))
    assert np.allclose(values, dense[:n], rtol=0, atol=1e-13 * scale)
    assert np.allclose(a @ vectors, vectors * values, rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(n), rtol=0, atol=1e-13)


def test_counts_of_indefinite_matrices():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-3, 4, (7, 7)).astype(float)
        a = x + x.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.standard_normal(3) * 4:
            assert spectrum.inertia_above(a, shift) == int((values > shift).sum())


def test_nothing_to_find():
    for a in (np.zeros((0, 0)), np.zeros((3, 3))):
        values, vectors = spectrum.leading(a, 8)
        assert not len(values) and vectors.shape == (len(a), 0)


# --- whitening


def plain_whitening(rows, k=8):
    """Per usable row its exact deviation, and n, the covariance from fractions, its eigenpairs."""
    used = [(i, v) for i, _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in used), default=0)
    xs = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in used]
    n = len(xs)
    sums = [sum(col) for col in zip(*xs, strict=True)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(row, sums, strict=True)] for row in xs]
    covariance = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    deviations = [(i, sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True))) for (i, _), row in zip(used, xs, strict=True)]
    values, vectors = np.linalg.eigh(covariance)
    return deviations, n, np.array(centred, float), covariance, values[::-1][:k], vectors[:, ::-1][:, :k]


def test_whitening_equals_a_plain_computation(spark):
    rows = random_rows(150, 12, 3, seed=9) + AWKWARD + random_rows(3, 12, 3, seed=10)
    deviations, n, centred, covariance, values, vectors = plain_whitening(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    df = df.withColumns({name: F.lit("extra") for name in ("id", "v", "w", "n", "component", "place", "deviation")})
    out = whiten.whitened(df).collect()
    assert len(out) == 8 * len(deviations) and {r["n"] for r in out} == {n}
    assert sorted({(r["vec_id"], r["deviation"]) for r in out}, key=repr) == sorted(set(deviations), key=repr)
    expected = centred @ vectors / np.sqrt(values)
    for c in range(8):
        mine = sorted((repr(r["vec_id"]), r["whitened"]) for r in out if r["component"] == c + 1)
        sign = 1 if np.allclose(*(sorted(x) for x in ([m[1] for m in mine], expected[:, c])), atol=1e-9) else -1
        theirs = sorted((repr(i), sign * x) for (i, _), x in zip(deviations, expected[:, c], strict=True))
        assert [m[0] for m in mine] == [t[0] for t in theirs]
        assert np.allclose([m[1] for m in mine], [t[1] for t in theirs], atol=1e-9)
        assert [*{r["explained"] for r in out if r["component"] == c + 1}] == [pytest.approx(values[c] / np.trace(covariance), rel=1e-12)]
    whole = np.array([[r["whitened"] for r in out if r["component"] == c + 1] for c in range(8)])
    assert {r["identity_error"] for r in out} and all(r["identity_error"] < 1e-12 for r in out)
    assert np.allclose(np.mean(whole**2, axis=1), 1, atol=1e-12)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(11)
    rows = [(k, 0, (rng.standard_normal(3) * 2.0**15).astype(np.float32).tolist()) for k in range(40)]
    deviations, *_ = plain_whitening(rows)
    out = {r["vec_id"]: r["deviation"] for r in whiten.whitened(spark.createDataFrame(rows, ROWS)).collect()}
    assert out == {i: x if x < 2**63 else None for i, x in deviations} and any(x < 2**63 for _, x in deviations)
    rows = [(k, 0, (rng.standard_normal(3) * 2.0**28).astype(np.float32).tolist()) for k in range(40)]
    assert {r["deviation"] for r in whiten.whitened(spark.createDataFrame(rows, ROWS)).collect()} == {None}


def test_few_directions(spark):
    def count(rows):
        return whiten.whitened(spark.createDataFrame(rows, ROWS)).groupBy("component").count().count()

    assert count([]) == 0
    assert count([(1, 0, [0.1, 0.2])]) == 0
    assert count([(k, 0, [0.1, 0.2]) for k in range(5)]) == 0
    assert count([(1, 0, []), (2, 0, None)]) == 0
    assert count([(k, 0, [0.5 * (k % 2), 1.0, 0.25 * (k % 2)]) for k in range(6)]) == 1
    assert count([(k, 0, [float(k == j) for j in range(3)]) for k in range(3)]) == 2
