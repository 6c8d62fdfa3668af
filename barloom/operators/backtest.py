"""Moving-average crossover backtest."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.operators.averages import with_averages

START_CASH = 10000.0
#: Rounding of a purchase and sale at one price.
SAME = 1e-8
SINCE = datetime.date(2012, 1, 1)


def crossover(
    bars: DataFrame, fast: int = 14, slow: int = 200, since: datetime.date | None = SINCE
) -> DataFrame:
    """Both averages per bar where the slow one exists: one window pass, no join."""
    if fast >= slow:
        raise ValueError("the fast window must be shorter than the slow one")
    both = with_averages(bars.select("symbol", "date", "close"), {"mat1": fast, "mat2": slow})
    # A series shorter than a window has no average at all, not a sentinel.
    kept = F.col("mat2") > 0
    if since is not None:
        kept &= F.col("date") >= F.lit(since)
    return both.where(kept)


def joined_crossover(
    slow: DataFrame, fast: DataFrame, since: datetime.date | None = SINCE
) -> DataFrame:
    """``crossover`` from two stored average tables: the slow one left-joined with the fast."""
    kept = F.col("close_mat") > 0
    if since is not None:
        kept &= F.col("date") >= F.lit(since)
    mat2 = slow.where(kept).select("symbol", "date", "close", F.col("close_mat").alias("mat2"))
    mat1 = fast.select("symbol", "date", F.col("close_mat").alias("mat1"))
    return mat2.join(mat1, ["symbol", "date"], "left").select(
        "symbol", "date", "close", "mat1", "mat2"
    )


def ledger(averages: DataFrame) -> DataFrame:
    """Signal (1 buy, 2 sell, 0 none), cash, stock and net worth per bar.

    The whole worth is in stock after a bar with ``mat1 > mat2`` and in cash
    otherwise. A run of bars in stock multiplies the worth by the close at its sale over
    the close at its purchase, so the number of shares is the cash at the purchase
    over its close and stays the same until the sale, whatever the closes between.
    Without a close above zero there is no trade on a bar: a purchase or sale waits for
    the next bar that has one, and net worth counts the last known close; a close of zero
    makes shares worth nothing for that bar only.
    """
    at = averages.withColumns({"_i": s.position(), "_priced": F.coalesce(F.col("close") > 0, F.lit(False))})
    wanted = (F.col("_i") > 0) & F.coalesce(F.col("mat1") > F.col("mat2"), F.lit(False))
    # On a bar without a price the position stays as it was.
    decided = at.withColumn("_decided", F.when(F.col("_priced"), wanted))
    held = decided.withColumn(
        "_held", F.coalesce(F.last("_decided", ignorenulls=True).over(s.so_far()), F.lit(False))
    )
    traded = held.withColumn("_was_held", F.coalesce(F.lag("_held").over(s.series()), F.lit(False)))
    buys, sells = F.col("_held") & ~F.col("_was_held"), ~F.col("_held") & F.col("_was_held")
    # Each purchase divides by its close and each sale multiplies with its own: what is
    # left over is the worth in cash, or the number of shares while they are held.
    factor = F.when(buys, F.lit(1.0) / F.col("close")).when(sells, F.col("close")).otherwise(1.0)
    known = F.last("close", ignorenulls=True).over(s.so_far())
    worth = traded.withColumns(
        {"_units": F.product(factor).over(s.so_far()) * START_CASH, "_known": known}
    ).withColumn("net", F.when(F.col("_held"), F.col("_units") * F.col("_known")).otherwise(F.col("_units")))
    return worth.select(
        "symbol",
        "date",
        "close",
        "mat1",
        "mat2",
        F.when(buys, 1).when(sells, 2).otherwise(0).alias("signal"),
        F.when(F.col("_held"), 0.0).otherwise(F.col("_units")).alias("cash"),
        F.when(F.col("_held"), F.col("_units")).otherwise(0.0).alias("stock"),
        "net",
    )


def summary(trades: DataFrame) -> DataFrame:
    """Per symbol: extremes of net worth, bars above and below the start, last date and worth.

    Worth within ``SAME`` of the start counts as neither above nor below it.
    """
    return trades.groupBy("symbol").agg(
        F.max("net").alias("max"),
        F.min("net").alias("min"),
        F.count_if(F.col("net") > START_CASH + SAME).alias("more_count"),
        F.count_if(F.col("net") < START_CASH - SAME).alias("less_count"),
        F.max("date").alias("date"),
        F.max_by("net", "date").alias("net"),
    )
