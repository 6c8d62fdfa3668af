"""Breakout labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.functions.scalars import whole_part

HIGH_BARS = 40
RANGE_BARS = 9
DAYS_AFTER = 5
SMALLEST_GAP = 0.01
NO_LABEL = -1


def _wide_new_high(back: int = 0) -> Column:
    """Whether the bar ``back`` bars ago has the highest high of 40 bars and the widest range of 9.

    The frames are shifted instead of the result, which keeps it to one window pass.
    """

    def highest(value: Column, bars: int) -> Column:
        return F.max(value).over(s.series().rowsBetween(1 - bars - back, -back))

    def then(value: Column) -> Column:
        return F.lag(value, back).over(s.series()) if back else value

    high, spread = F.col("high"), F.col("high") - F.col("low")
    return (then(high) >= highest(high, HIGH_BARS)) & (then(spread) >= highest(spread, RANGE_BARS))


def _days_after(base: str) -> dict[str, Column]:
    """``fwd1`` ... ``fwd5``: whole part of later closes over ``base``; -1 without a label."""
    return {
        f"fwd{k}": F.when(
            F.col("label") == 1, whole_part(F.try_divide(s.following("close", k), F.col(base)))
        ).otherwise(NO_LABEL)
        for k in range(1, DAYS_AFTER + 1)
    }


def up_breakouts(bars: DataFrame) -> DataFrame:
    """Bars with 40 bars up to and 5 bars after them, labelled 1 on a wide new high.

    Symbols with 40 bars or fewer have no rows.
    """
    labelled = (
        bars.withColumns({"_i": s.position(), "_bars": s.length(), "_flag": _wide_new_high()})
        .withColumn("label", F.col("_flag").cast("int"))
        .withColumns(_days_after("close"))
    )
    kept = (
        (F.col("_bars") > HIGH_BARS)
        & (F.col("_i") >= HIGH_BARS - 1)
        & (F.col("_i") < F.col("_bars") - DAYS_AFTER)
    )
    return labelled.where(kept).drop("_i", "_bars", "_flag")


def with_gap_up(bars: DataFrame, name: str = "label") -> DataFrame:
    """Add 1 where the bar gaps above a wide new high of the day before, else 0; NULL before bar 40."""
    gap = F.col("high") - s.previous("high") >= SMALLEST_GAP
    return bars.withColumn(
        name, F.when(s.position() >= HIGH_BARS, (_wide_new_high(back=1) & gap).cast("int"))
    )


def gap_up_breakouts(bars: DataFrame) -> DataFrame:
    """Bars from the 41st on with the gap-up label; ``fwd*`` are NULL past the end of the series."""
    return with_gap_up(bars).withColumns(_days_after("high")).where(F.col("label").isNotNull())
