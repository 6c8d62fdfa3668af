from __future__ import annotations

import pytest
from helpers import by_key, day, frame, random_walk

from barloom.operators import averages, backtest


def stored(spark, values):
    rows = [("AAA", day(f"2016-01-0{d}"), close, mat) for d, close, mat in values]
    return spark.createDataFrame(rows, "symbol string, date date, close double, close_mat double")


def test_known_ledger(spark):
    fast = stored(
        spark,
        [(1, 1.0, 1.0), (6, 1.2, 1.2), (2, 1.0, 1.2), (3, 1.2, 1.3), (7, 1.1, 1.0), (4, 1.3, 1.4), (5, 1.3, 1.3)],
    )
    slow = stored(
        spark,
        [(1, 1.0, 1.1), (6, 1.2, 1.1), (2, 1.0, 1.1), (3, 1.2, 1.1), (7, 1.1, 1.1), (4, 1.3, 1.1), (5, 1.3, 1.1)],
    )
    trades = backtest.ledger(backtest.joined_crossover(slow, fast)).orderBy("date").collect()
    assert [r["signal"] for r in trades] == [0, 1, 0, 0, 0, 0, 2]
    assert trades[-1]["cash"] == pytest.approx(11000)
    assert trades[1]["stock"] == pytest.approx(10000)
    summary = backtest.summary(backtest.ledger(backtest.joined_crossover(slow, fast))).first()
    assert summary["max"] == pytest.approx(13000)
    assert summary["net"] == pytest.approx(11000)
    assert (summary["more_count"], summary["less_count"]) == (5, 0)
    assert summary["date"] == day("2016-01-07")


def plain_ledger(pairs):
    cash, stock, out = 10000.0, 0.0, []
    for i, r in enumerate(pairs):
        signal = 0
        if i:
            if r["mat1"] is not None and r["mat1"] > r["mat2"]:
                if cash > 0:
                    signal, stock, cash = 1, cash / r["close"], 0.0
            elif stock > 0:
                signal, cash, stock = 2, stock * r["close"], 0.0
        out.append((signal, cash, stock, cash + stock * r["close"]))
    return out


def test_ledger_is_the_plain_loop(spark):
    bars = frame(spark, random_walk("A", 400) + random_walk("B", 400) + random_walk("SHORT", 29))
    pairs = backtest.crossover(bars, 5, 30, since=None)
    found = by_key(backtest.ledger(pairs))
    assert len(found) == 2 * (400 - 29)
    for symbol in "AB":
        rows = sorted((r for (s, _), r in found.items() if s == symbol), key=lambda r: r["date"])
        for row, (signal, cash, stock, net) in zip(rows, plain_ledger(rows), strict=True):
            assert row["signal"] == signal
            assert row["cash"] == pytest.approx(cash)
            assert row["stock"] == pytest.approx(stock)
            assert row["net"] == pytest.approx(net)
            assert row["net"] >= 0 and row["cash"] * row["stock"] == 0


def test_window_and_join_forms_agree(spark):
    bars = frame(spark, random_walk("A", 100) + random_walk("B", 60))
    averaged = averages.moving_averages(bars, [5, 30])
    slow, fast = (averaged.where(f"window = {n}") for n in (30, 5))
    since = day("1990-02-20")
    joined = by_key(backtest.joined_crossover(slow, fast, since))
    assert joined == by_key(backtest.crossover(bars, 5, 30, since))
    assert min(d for _, d in joined) == since


def test_windows_must_be_in_order(spark):
    with pytest.raises(ValueError):
        backtest.crossover(frame(spark, random_walk("A", 5)), 20, 20)


@pytest.mark.parametrize("bad", [0.0, None])
def test_a_close_of_nothing_keeps_the_shares(spark, bad):
    closes = [1.0, 2.0, bad, 4.0, 4.0]
    rows = [("AAA", day(f"2016-01-0{d + 1}"), c, 2.0 if 0 < d < 4 else 1.0, 1.5) for d, c in enumerate(closes)]
    pairs = spark.createDataFrame(rows, "symbol string, date date, close double, mat1 double, mat2 double")
    trades = backtest.ledger(pairs).orderBy("date").collect()
    assert [r["signal"] for r in trades] == [0, 1, 0, 0, 2]
    assert [r["stock"] for r in trades] == pytest.approx([0, 5000, 5000, 5000, 0])
    assert [r["net"] for r in trades] == pytest.approx([10000, 10000, 0 if bad == 0 else 10000, 20000, 20000])
    assert trades[-1]["cash"] == pytest.approx(20000)


def test_trades_wait_for_a_price(spark):
    rows = [("AAA", day(f"2016-01-0{d + 1}"), c, m, 1.5) for d, (c, m) in enumerate([(1.0, 1.0), (0.0, 2.0), (2.0, 2.0), (None, 1.0), (3.0, 1.0)])]
    pairs = spark.createDataFrame(rows, "symbol string, date date, close double, mat1 double, mat2 double")
    trades = backtest.ledger(pairs).orderBy("date").collect()
    assert [r["signal"] for r in trades] == [0, 0, 1, 0, 2]
    assert trades[-1]["net"] == pytest.approx(15000)
