"""One more day from the state against the pass over the whole series."""

from __future__ import annotations

import datetime

import pytest
from helpers import by_key, frame, random_walk
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import averages, directional, state

WALKS = {"A": 120, "B": 40, "C": 27, "D": 10, "E": 1}
WINDOWS = (3, 8, 20)


@pytest.fixture(scope="module")
def bars(spark):
    return storage.materialize(frame(spark, [r for s, n in WALKS.items() for r in random_walk(s, n)]), "bars")


def whole(bars):
    """The values of the full pass, a row a bar."""
    index = directional.with_index(bars.select("symbol", "date", "high", "low", "close"))
    names = {f"mat{n}": n for n in WINDOWS}
    return by_key(averages.with_averages(index, names))


def same(rows, expected):
    assert rows
    for key, row in rows.items():
        for name, value in row.items():
            assert value == pytest.approx(expected[key][name], rel=1e-9, abs=1e-9) if name not in ("symbol", "date") else True


def cut(bars, n):
    return bars.where(F.col("date") < F.lit(datetime.date(1990, 1, 1) + datetime.timedelta(days=n)))


@pytest.mark.parametrize("known", [0, 1, 5, 14, 20, 27, 28, 39, 100])
def test_state_plus_new_bars_equals_the_full_pass(spark, bars, known):
    old = cut(bars, known)
    first = storage.materialize(state.state_of(old, WINDOWS), "state")
    advanced = storage.materialize(state.advance(first, bars.exceptAll(old), WINDOWS), "advanced")
    rows, expected = by_key(state.indicators(advanced)), whole(bars)
    assert set(rows) == {k for k in expected if k[1] >= datetime.date(1990, 1, 1) + datetime.timedelta(days=known)}
    if rows:
        same(rows, expected)
    ends = {r["symbol"]: r["state"] for r in advanced.collect()}
    again = {r["symbol"]: r["state"] for r in state.state_of(bars, WINDOWS).collect()}
    assert set(ends) == set(again)
    for symbol, end in again.items():
        for name in ("i", "close", "tr14", "pdm14", "mdm14", "adx", "closes"):
            assert ends[symbol][name] == pytest.approx(end[name], rel=1e-9, abs=1e-9)


def test_day_by_day_equals_at_once(spark, bars):
    current = storage.materialize(state.state_of(cut(bars, 25), WINDOWS), "state")
    rows = {}
    for day in range(25, 31):
        new = cut(bars, day + 1).exceptAll(cut(bars, day))
        advanced = storage.materialize(state.advance(current, new, WINDOWS), "advanced")
        rows |= by_key(state.indicators(advanced))
        current = advanced.select("symbol", "state")
    assert len(rows) == 2 * 6 + 2  # A and B each day, C for two more
    same(rows, whole(bars))


def test_the_history_is_not_read(spark, bars):
    stored = storage.materialize(state.state_of(bars, WINDOWS), "state")
    new = storage.materialize(frame(spark, random_walk("A", 121)).where("date > '1990-04-30'"), "new_bars")
    advanced = state.advance(stored, new, WINDOWS)
    assert {f.rpartition("/")[0].rpartition("/")[2] for f in advanced.inputFiles()} == {"state", "new_bars"}
    assert state.indicators(advanced).count() == 1


def test_late_bars_renew_their_symbols(spark, bars):
    old = bars.where("not (symbol = 'A' and date = '1990-02-01')")
    first = storage.materialize(state.state_of(old, WINDOWS), "state")
    added = bars.where("symbol = 'A' and date = '1990-02-01'").union(frame(spark, random_walk("B", 41)).where("date = '1990-02-10'"))
    stale = state.late(first, added)
    assert [r["symbol"] for r in stale.collect()] == ["A"]
    assert by_key(state.indicators(state.advance(first, added, WINDOWS))).keys() == {("B", datetime.date(1990, 2, 10))}
    anew = {r["symbol"]: r["state"] for r in state.renewed(first, bars, stale, WINDOWS).collect()}
    expected = {r["symbol"]: r["state"] for r in state.state_of(bars, WINDOWS).collect()}
    assert anew == expected and anew["A"] != {r["symbol"]: r["state"] for r in first.collect()}["A"]


def test_nothing_new_and_nothing_known(spark, bars):
    empty = bars.limit(0)
    none = state.state_of(empty, WINDOWS)
    assert none.count() == 0 and state.indicators(state.advance(none, empty, WINDOWS)).count() == 0
    stored = state.state_of(bars, WINDOWS)
    kept = {r["symbol"]: r["state"] for r in state.advance(stored, empty, WINDOWS).collect()}
    assert kept == {r["symbol"]: r["state"] for r in stored.collect()}


def test_a_high_below_its_low_fails(spark, bars):
    broken = bars.withColumn("high", F.col("low") - 1)
    with pytest.raises(Exception, match="high below low"):
        state.state_of(broken, WINDOWS).collect()
