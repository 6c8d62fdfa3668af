"""Indicators for the next days, from one row a symbol instead of the whole history.

The state of a series holds what its averages and its directional index go on from: the last bar, its position, the
decaying sums and the last closes. New bars are folded into it in order of date, one by one, so a day costs its own
bars and the state, and the history isn't read. The state of a whole history comes from the same fold.

A symbol has a row a day at most, so the bars that are gathered for it are bounded by the calendar. Bars that aren't
later than a symbol's state can't be folded in: ``late`` names those symbols, ``advance`` leaves their late bars
out, and ``renewed`` makes their state anew from their own history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.averages import NO_HISTORY
from barloom.operators.directional import DECAY, FIRST_INDEX, PERIOD
from barloom.schemas import DIRECTIONAL_VALUES

WINDOWS = (8, 20)
_FIELDS = "i:int,date:date,high:double,low:double,close:double,tr14:double,pdm14:double,mdm14:double,adx:double,closes:array<double>"
_ROW = ",".join(f"{name}:double" for name in DIRECTIONAL_VALUES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _moved(state: Column, bar: Column) -> Column:
    """Position, true range and movement of a bar after a state; NULL on the first bar."""
    i = state["i"] + 1
    high, low = bar["high"], bar["low"]
    ordered = F.when(
        high < low, F.raise_error(F.concat(F.lit("high below low on "), bar["date"].cast("string"))).cast("double")
    ).otherwise(high - low)
    up, down = high - state["high"], state["low"] - low
    later = i > 0
    return F.struct(
        i.alias("i"),
        F.when(later, F.greatest(ordered, F.abs(high - state["close"]), F.abs(low - state["close"]))).alias("tr"),
        F.when(later, F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(0.0)).alias("pdm1"),
        F.when(later, F.when(down > up, F.greatest(down, F.lit(0.0))).otherwise(0.0)).alias("mdm1"),
    )


def _summed(state: Column, moved: Column) -> Column:
    """The 14-bar sums: plain up to the 14th movement, decaying from there."""
    decay = F.when(moved["i"] > PERIOD, F.lit(DECAY)).otherwise(1.0)
    sums = [
        (state[total] * decay + F.coalesce(moved[part], F.lit(0.0))).alias(total)
        for total, part in (("tr14", "tr"), ("pdm14", "pdm1"), ("mdm14", "mdm1"))
    ]
    return F.struct(*sums)


def _folded(state: Column, bar: Column, windows: Sequence[int], keep_rows: bool) -> Column:
    """The state after one more bar; with ``keep_rows`` the bar's indicators are added to its rows."""

    def with_sums(moved: Column, sums: Column) -> Column:
        apart = F.abs(sums["pdm14"] - sums["mdm14"])
        strength = F.coalesce(F.try_divide(apart, sums["pdm14"] + sums["mdm14"]), F.lit(0.0)) * 100
        return _let(F.when(moved["i"] >= PERIOD, strength).otherwise(0.0), lambda dx: with_index(moved, sums, dx))

    def with_index(moved: Column, sums: Column, dx: Column) -> Column:
        # Added up until there are enough, then their mean, which decays from there.
        adx = (
            F.when(moved["i"] < FIRST_INDEX, state["adx"] + dx)
            .when(moved["i"] == FIRST_INDEX, (state["adx"] + dx) / PERIOD)
            .otherwise(state["adx"] * DECAY + dx / PERIOD)
        )
        longest = max(windows)
        # The last closes; a slice from the end needs that many.
        closes = F.concat(state["closes"], F.array(bar["close"]))
        closes = F.when(F.size(closes) > longest, F.slice(closes, 2, longest)).otherwise(closes)
        return _let(F.struct(adx.alias("adx"), closes.alias("closes")), lambda last: ended(moved, sums, dx, last))

    def ended(moved: Column, sums: Column, dx: Column, last: Column) -> Column:
        fields = [moved["i"], bar["date"], bar["high"], bar["low"], bar["close"], sums["tr14"], sums["pdm14"], sums["mdm14"], last["adx"], last["closes"]]
        names = [f.split(":")[0] for f in _FIELDS.split(",")]
        after = [f.alias(n) for f, n in zip(fields, names, strict=True)]
        if not keep_rows:
            return F.struct(*after)
        rows = F.concat(state["rows"], F.array(_row(bar, moved, sums, dx, last, windows)))
        return F.struct(*after, rows.alias("rows"))

    return _let(_moved(state, bar), lambda moved: _let(_summed(state, moved), lambda sums: with_sums(moved, sums)))


def _row(bar: Column, moved: Column, sums: Column, dx: Column, last: Column, windows: Sequence[int]) -> Column:
    """A bar's indicators, -1.0 where there is too little history."""
    i = moved["i"]

    def since(first: int, value: Column) -> Column:
        return F.when(i >= first, value).otherwise(NO_HISTORY)

    def share(name: str) -> Column:
        return F.coalesce(F.try_divide(sums[name], sums["tr14"]), F.lit(0.0)) * 100

    plus, minus = share("pdm14"), share("mdm14")
    values = [
        *(F.coalesce(moved[name], F.lit(NO_HISTORY)) for name in ("tr", "pdm1", "mdm1")),
        *(since(PERIOD, sums[name]) for name in ("tr14", "pdm14", "mdm14")),
        since(PERIOD, plus),
        since(PERIOD, minus),
        since(PERIOD, F.abs(plus - minus)),
        since(PERIOD, plus + minus),
        since(PERIOD, dx),
        since(FIRST_INDEX, last["adx"]),
    ]
    averages = [
        F.when(i < n - 1, F.lit(NO_HISTORY)).otherwise(
            F.aggregate(F.slice(last["closes"], -n, n), F.lit(0.0), lambda total, x: total + x) / n
        )
        for n in windows
    ]
    # Fewer closes than a window has would make the slice begin before the first.
    averages = [F.when(F.size(last["closes"]) >= n, a).otherwise(NO_HISTORY) for n, a in zip(windows, averages, strict=True)]
    return F.struct(
        bar["date"].alias("date"),
        bar["close"].alias("close"),
        i.alias("i"),
        *(a.alias(f"mat{n}") for n, a in zip(windows, averages, strict=True)),
        *(v.alias(name) for name, v in zip(DIRECTIONAL_VALUES, values, strict=True)),
    )


def _row_type(windows: Sequence[int]) -> str:
    averages = "".join(f"mat{n}:double," for n in windows)
    return f"array<struct<date:date,close:double,i:int,{averages}{_ROW}>>"


def _start(windows: Sequence[int], keep_rows: bool, known: Column | None) -> Column:
    """What a fold begins with: the state, or that of a symbol without bars."""
    none = F.struct(
        F.lit(-1).alias("i"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in [("date", "date"), ("high", "double"), ("low", "double"), ("close", "double")]),
        *(F.lit(0.0).alias(name) for name in ("tr14", "pdm14", "mdm14", "adx")),
        F.array().cast("array<double>").alias("closes"),
    ).cast(f"struct<{_FIELDS}>")
    state = none if known is None else F.coalesce(known, none)
    if not keep_rows:
        return state
    names = [f.split(":")[0] for f in _FIELDS.split(",")]
    return F.struct(*(state[n].alias(n) for n in names), F.array().cast(_row_type(windows)).alias("rows"))


def _gathered(bars: DataFrame) -> DataFrame:
    """A symbol's bars as one array in order of date."""
    return bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "high", "low", "close"))).alias("bars"))


def state_of(bars: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``symbol, state``: one row a symbol, after all its bars."""
    state = F.aggregate("bars", _start(windows, False, None), lambda s, bar: _folded(s, bar, windows, False))
    return _gathered(bars).select("symbol", state.alias("state"))


def late(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The symbols with bars that aren't later than their state."""
    first = bars.groupBy("symbol").agg(F.min("date").alias("_first"))
    return first.join(state, "symbol").where(F.col("_first") <= F.col("state.date")).select("symbol")


def renewed(state: DataFrame, history: DataFrame, symbols: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The state with that of ``symbols`` made anew from ``history``."""
    own = state_of(history.join(symbols, "symbol", "left_semi"), windows)
    return state.join(symbols, "symbol", "left_anti").unionByName(own)


def advance(state: DataFrame, bars: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``symbol, state, rows``: the state after the new bars and the indicators of each of them."""
    both = state.join(_gathered(bars), "symbol", "full")
    none = F.array().cast("array<struct<date:date,high:double,low:double,close:double>>")
    fresh = F.filter(F.coalesce("bars", none), lambda b: F.col("state").isNull() | (b["date"] > F.col("state.date")))
    folded = both.select(
        "symbol", F.aggregate(fresh, _start(windows, True, F.col("state")), lambda s, bar: _folded(s, bar, windows, True)).alias("end")
    )
    names = [f.split(":")[0] for f in _FIELDS.split(",")]
    return folded.select("symbol", F.struct(*(F.col(f"end.{n}").alias(n) for n in names)).alias("state"), F.col("end.rows").alias("rows"))


def indicators(advanced: DataFrame) -> DataFrame:
    """A row for each new bar: ``symbol, date, close, i``, the averages and the directional values."""
    return advanced.select("symbol", F.explode("rows").alias("row")).select("symbol", "row.*")
