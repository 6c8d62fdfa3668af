from __future__ import annotations

import datetime
import random

import pytest
from helpers import by_key, day, frame, random_walk
from pyspark.sql import functions as F

from barloom.functions import series
from barloom.operators import features, mart

CLOSES = [round(0.1 * i, 1) for i in range(1, 20)] + [1.4, 1.4]


def closes(spark):
    dates = [f"2014-12-{d}" for d in range(20, 32)] + [f"2015-01-0{d}" for d in range(1, 10)]
    rows = [("AAA", day(d), c) for d, c in zip(dates, CLOSES, strict=True)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def last_point(points):
    row = points.orderBy("date").tail(1)[0]
    return row["label"], list(row["features"])


def test_known_lag_ratio_points(spark):
    train, check = features.split_at(closes(spark), day("2014-12-31"))
    points = features.lag_ratio_points(train, 5, 2)
    assert points.count() == 5
    label, values = last_point(points)
    assert label == pytest.approx(1.2)
    assert values == pytest.approx([1.2, 1.16666666667, 1.14285714286, 1.125, 1.11111111111])
    points = features.lag_ratio_points(check, 5, 2)
    assert points.count() == 2
    label, values = last_point(points)
    assert label == pytest.approx(0.736842105263)
    assert values == pytest.approx(
        [1.07142857143, 1.06666666667, 1.0625, 1.05882352941, 1.05555555556]
    )


@pytest.mark.parametrize("bad", [0.0, None])
def test_vectors_keep_their_length_beside_an_undefined_ratio(spark, bad):
    rows = [("AAA", day(f"2014-12-{d}"), bad if d == 15 else 1.0 + d / 10) for d in range(10, 30)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    points = features.lag_ratio_points(bars, 5, 2).collect()
    assert points and all(len(p["features"]) == 5 and None not in p["features"] for p in points)
    # Bars 15 to 20 have an undefined ratio in their window, 13 an undefined label.
    days = {p["date"].day for p in points}
    assert not days & {*range(16, 21)} and {21, 22} <= days


def test_split_series_are_those_of_split_bars(spark):
    marked = features.lag_ratio_points(features.marked_at(closes(spark), day("2014-12-31")), 5, 2, "part")
    for name, rows in zip(["train", "check"], features.split_at(closes(spark), day("2014-12-31")), strict=True):
        expected = features.lag_ratio_points(rows, 5, 2).collect()
        assert sorted(marked.where(f"part = '{name}'").drop("part").collect()) == sorted(expected)


def test_rising_points_are_strict(spark):
    points = features.rising_points(closes(spark), 2, 1).orderBy("date").collect()
    assert [p["label"] for p in points] == [1.0] * 16 + [0.0, 0.0]


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError):
        features.lag_ratio_points(closes(spark), 1, 1)
    with pytest.raises(ValueError):
        features.forward_labels(closes(spark), 1, 1)


def mart_rows(n=40):
    rng = random.Random(5)
    rows = []
    for symbol in ["A", "B"]:
        for i, bar in enumerate(random_walk(symbol, n)):
            rows.append(
                {
                    **bar,
                    "mat_dual": rng.uniform(0.8, 1.2),
                    "adx": rng.uniform(5, 95),
                    "pdi14": rng.uniform(1, 50),
                    "mdi14": 0.0 if i == 7 else rng.uniform(1, 50),
                    "gupbreak": rng.choice([None, 0, 1]),
                }
            )
    return rows


def mart_frame(spark, rows):
    schema = (
        "symbol string, date date, close double, volume double, mat_dual double, adx double, "
        "pdi14 double, mdi14 double, gupbreak int"
    )
    names = ["symbol", "date", "close", "volume", "mat_dual", "adx", "pdi14", "mdi14", "gupbreak"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def plain_features(x, a, n):
    def two(value):
        return int(value * 100 + 0.5) / 100

    def direction(r):
        return two(r["pdi14"] / r["mdi14"]) if r["mdi14"] else 0.0

    window = range(a - n + 1, a + 1)
    values = [two(x[j]["close"] / x[j - 1]["close"]) for j in window]
    values += [two(x[j]["close"] / x[j - 2]["close"]) for j in window if j > a - n + 1]
    for j in window:
        strong = x[j]["adx"] > 30 and x[j]["pdi14"] > x[j]["mdi14"]
        values += [1.0 if strong else 0.0, direction(x[j])]
    anchor = x[a]
    values += [two(anchor["mat_dual"]), direction(anchor), int(anchor["adx"] / 30)]
    return [*values, float(anchor["gupbreak"] or 0)]


def test_mart_features_are_the_plain_loop(spark):
    rows = mart_rows()
    found = by_key(features.mart_features(mart_frame(spark, rows), window=3, coach=2))
    assert len(found) == 2 * 37
    for symbol in ["A", "B"]:
        x = [r for r in rows if r["symbol"] == symbol]
        for a in range(3, 40):
            row = found[(symbol, x[a]["date"])]
            assert len(row["features"]) == 15
            assert row["features"] == pytest.approx(plain_features(x, a, 3)), a
            assert row["date1"] == x[a - 3]["date"] and row["date2"] == x[a]["date"]
            if a + 2 < 40:
                ahead = x[a + 2]["close"] / x[a]["close"]
                assert row["act_diff"] == pytest.approx(ahead)
                assert row["date3"] == x[a + 2]["date"]
                assert (row["is_labeled"], row["label"]) == (1, int(ahead >= 1))
            else:
                assert row["date3"] is None and row["act_diff"] == -1.0
                assert (row["is_labeled"], row["label"]) == (0, 1)
            assert "volume" not in row


def test_spans_keep_unlabelled_rows(spark):
    points = features.forward_labels(mart_frame(spark, mart_rows()), 3, 2, unlabeled=-1)
    pending = points.where("is_labeled = 0")
    assert {r["label"] for r in pending.collect()} == {-1}
    start, end = day("1990-01-10"), day("1990-01-25")
    within = features.in_span(points, start, end)
    dates = [(r["date1"], r["date3"]) for r in within.collect()]
    assert min(d for d, _ in dates) == start
    assert sum(d is None for _, d in dates) == 4
    assert max(d for _, d in dates if d) == day("1990-01-24")
    train = features.train_rows(within, day("1990-01-20")).collect()
    assert max(r["date3"] for r in train) == day("1990-01-19")
    check = features.check_rows(within, day("1990-01-20")).collect()
    assert min(r["date2"] for r in check) == day("1990-01-21")


def test_symbol_ids_rank_all_symbols(spark):
    bars = spark.range(5000).select(
        F.concat(F.lit("S"), (F.col("id") * 7919) % 1234).alias("symbol")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r["symbol"]: (r["id"], r["id_num"]) for r in mart.symbol_ids(bars).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = sorted({f"S{i * 7919 % 1234}" for i in range(5000)})
    assert rows == {s: (i, len(expected)) for i, s in enumerate(expected)}


def test_mart_lists_rows_with_ratio_and_index(spark):
    symbols = ["A", "B", "LATE"]
    bars = frame(
        spark,
        random_walk("A", 80)
        + random_walk("B", 80)
        + random_walk("LATE", 10)
        + random_walk("GONE", 5, start=day("1980-01-01")),
    )
    benchmark = frame(spark, random_walk("SPX", 90))
    rows = by_key(mart.feature_mart(bars, benchmark))
    # 27 bars of index history; the first benchmark day has no relative bar.
    assert len(rows) == 2 * (80 - 1 - 27)
    assert {r["symbol"]: r["id"] for r in rows.values()} == {"A": 0, "B": 1}
    assert {r["id_num"] for r in rows.values()} == {len(symbols)}
    assert all(r["mat_dual"] > 0 and r["adx"] > 0 for r in rows.values())
    later = by_key(mart.feature_mart(bars, benchmark, since=day("1990-01-11")))
    assert len(later) == 2 * (80 - 10 - 27)
    assert all(rows[k]["gupbreak"] == r["gupbreak"] for k, r in later.items())


def test_gathered_arrays_are_the_last_bars_in_order(spark):
    rows = [{"symbol": x, "date": day("1990-01-01") + datetime.timedelta(days=i), "v": None if i % 7 == 3 else i + 0.5} for x in "AB" for i in range(75)]
    bars = spark.createDataFrame(rows, "symbol string, date date, v double")
    sizes = [1, 2, 3, 5, 29, 30, 60]
    unit = F.array("v", F.lit(1.0))
    found = series.with_gathered(bars, {f"n{n}": (unit, n) for n in sizes})
    assert found.columns == ["symbol", "date", "v", *(f"n{n}" for n in sizes)]
    got = by_key(found)
    for symbol in "AB":
        x = [r for r in rows if r["symbol"] == symbol]
        for i, r in enumerate(x):
            for n in sizes:
                expected = [y for o in x[i - n + 1 : i + 1] for y in (o["v"], 1.0)] if i >= n - 1 else None
                assert got[symbol, r["date"]][f"n{n}"] == expected, (i, n)


def test_features_do_not_visit_a_whole_window_for_each_bar(spark):
    points = features.mart_features(mart_frame(spark, mart_rows()), window=30, coach=1)
    text = points._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert "exists(" not in text


def test_anchors_with_an_undefined_term_in_their_window_are_left_out(spark):
    rng, rows = random.Random(5), [dict(r) for r in mart_rows()]
    for r in rows:
        if rng.random() < 0.12:
            name = rng.choice(["close", "adx", "pdi14", "mat_dual", "gupbreak"])
            r[name] = 0.0 if name == "close" and rng.random() < 0.5 else None
    found, n = by_key(features.mart_features(mart_frame(spark, rows), window=3, coach=2)), 3

    def strong(r):
        parts = [None if r["adx"] is None else r["adx"] > 30, None if None in (r["pdi14"], r["mdi14"]) else r["pdi14"] > r["mdi14"]]
        return False if False in parts else None if None in parts else True

    def divides(x, j, k):
        return x[j]["close"] is not None and bool(x[j - k]["close"])

    expected = set()
    for symbol in ["A", "B"]:
        x = [r for r in rows if r["symbol"] == symbol]
        for a in range(n, len(x)):
            window = range(a - n + 1, a + 1)
            known = all(divides(x, j, 1) and strong(x[j]) is not None for j in window) and all(divides(x, j, 2) for j in window[1:])
            if known and x[a]["mat_dual"] is not None and x[a]["adx"] is not None:
                expected.add((symbol, x[a]["date"]))
    assert set(found) == expected and 0 < len(expected) < 2 * 37
    assert all(len(r["features"]) == 15 and None not in r["features"] for r in found.values())
