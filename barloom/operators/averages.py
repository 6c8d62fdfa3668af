"""Moving averages and their ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import series as s

NO_HISTORY = -1.0
SHORTEST_SERIES = 3


def average_columns(windows: dict[str, int], price: str = "close") -> dict[str, Column]:
    """A moving average per entry (name -> window); -1.0 before the window is full."""
    return {
        name: F.when(s.position() < n - 1, F.lit(NO_HISTORY)).otherwise(
            F.avg(price).over(s.last_rows(n))
        )
        for name, n in windows.items()
    }


def with_averages(bars: DataFrame, windows: dict[str, int], price: str = "close") -> DataFrame:
    """The bars with a moving average per entry of ``windows``."""
    return bars.withColumns(average_columns(windows, price))


def moving_averages(bars: DataFrame, windows: Sequence[int] = (8, 20)) -> DataFrame:
    """One row per bar and window: ``symbol, date, close, window, close_mat``.

    A series shorter than the window has no rows for it. All windows are
    computed in one pass over the sorted series.
    """
    names = {f"_mat{n}": n for n in windows}
    averaged = with_averages(
        bars.select("symbol", "date", "close").withColumn("_bars", s.length()), names
    )
    entries = [
        F.struct(F.lit(n).alias("window"), F.col(name).alias("close_mat"))
        for name, n in names.items()
    ]
    long_enough = F.col("_bars") >= F.greatest(F.col("entry.window"), F.lit(SHORTEST_SERIES))
    return (
        averaged.select("symbol", "date", "close", "_bars", F.explode(F.array(*entries)).alias("entry"))
        .where(long_enough)
        .select("symbol", "date", "close", "entry.window", "entry.close_mat")
    )


def average_ratio(bars: DataFrame, fast: int = 8, slow: int = 20) -> DataFrame:
    """Ratio of the fast to the slow average where the slow one exists.

    Same rows as joining the two average tables on (symbol, date), without the join.
    """
    both = with_averages(
        bars.select("symbol", "date", "close"), {"close_mat1": fast, "close_mat2": slow}
    )
    return both.where(F.col("close_mat2") > 0).select(
        "symbol",
        "date",
        "close_mat1",
        "close_mat2",
        F.try_divide("close_mat1", "close_mat2").alias("mat_dual"),
    )


def join_averages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two stored average tables side by side: all rows of ``left``, ``right`` where it has them."""
    mat1 = left.select("symbol", "date", "close", F.col("close_mat").alias("mat1"))
    mat2 = right.select("symbol", "date", F.col("close_mat").alias("mat2"))
    return mat1.join(mat2, ["symbol", "date"], "left")


def joined_ratio(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """``average_ratio`` from two stored average tables (inner join on symbol and date)."""
    mat1 = fast.select("symbol", "date", F.col("close_mat").alias("close_mat1"))
    mat2 = slow.where(F.col("close_mat") > 0).select(
        "symbol", "date", F.col("close_mat").alias("close_mat2")
    )
    return mat1.join(mat2, ["symbol", "date"]).withColumn(
        "mat_dual", F.try_divide("close_mat1", "close_mat2")
    )


def calendar_averages(
    rows: DataFrame, windows: Sequence[int] = (7, 30), price: str = "close", ahead: int = 0
) -> DataFrame:
    """Averages over calendar days: ``symbol, date, window, rows, close_mat``.

    The frame of a date holds all rows of the ``window`` days that end with it, and of ``ahead`` days
    after it; days without rows have no weight and rows of one date count each. -1.0 where the
    series begins after the frame's first day.

    Rows of a date are added up before the shuffle, so a symbol sends one row a day and its
    window partition is bounded by the calendar however many rows it has.
    """
    days = rows.groupBy("symbol", "date").agg(
        F.sum(price).alias("_sum"), F.count(price).alias("_count")
    )
    # A range frame needs a number to measure distances with.
    numbered = days.withColumn("_day", F.unix_date("date"))
    by_day = Window.partitionBy("symbol").orderBy("_day")
    first = F.min("_day").over(by_day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    framed = numbered.withColumn("_first", first).withColumns(
        {
            f"_{what}{n}": F.sum(f"_{what}").over(by_day.rangeBetween(1 - n, ahead))
            for n in windows
            for what in ("sum", "count")
        }
    )
    entries = [
        F.struct(
            F.lit(n).alias("window"),
            F.col(f"_count{n}").alias("rows"),
            F.when(F.col("_first") > F.col("_day") - (n - 1), F.lit(NO_HISTORY))
            .otherwise(F.try_divide(f"_sum{n}", f"_count{n}"))
            .alias("close_mat"),
        )
        for n in windows
    ]
    return framed.select("symbol", "date", F.explode(F.array(*entries)).alias("entry")).select(
        "symbol", "date", "entry.window", "entry.rows", "entry.close_mat"
    )
