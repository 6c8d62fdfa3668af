"""True range, directional movement and the average directional index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.functions.recurrence import BLOCK, add_blocks, add_decayed_sums
from barloom.schemas import DIRECTIONAL_VALUES

PERIOD = 14
FIRST_INDEX = 2 * PERIOD - 1
DECAY = (PERIOD - 1) / PERIOD
NO_HISTORY = -1.0


def with_movement(bars: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Add ``i``, ``tr``, ``pdm1``, ``mdm1``: the day's true range and movement, NULL on bar 0.

    ``more`` names further window columns to compute in the same pass.
    """
    before = bars.withColumns(
        {
            **(more or {}),
            "i": s.position(),
            "_high": s.previous("high"),
            "_low": s.previous("low"),
            "_close": s.previous("close"),
        }
    )
    high, low = F.col("high"), F.col("low")
    ordered = F.when(
        high < low,
        F.raise_error(F.concat(F.lit("high below low for "), F.col("symbol"), F.lit(" on "), "date")),
    ).otherwise(high - low)
    up = high - F.col("_high")
    down = F.col("_low") - low
    later = F.col("i") > 0
    return before.withColumns(
        {
            "tr": F.when(
                later,
                F.greatest(ordered, F.abs(high - F.col("_close")), F.abs(low - F.col("_close"))),
            ),
            "pdm1": F.when(later, F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(0.0)),
            "mdm1": F.when(later, F.when(down > up, F.greatest(down, F.lit(0.0))).otherwise(0.0)),
        }
    ).drop("_high", "_low", "_close")


def movement(bars: DataFrame) -> DataFrame:
    """True range and directional movement per bar, -1.0 on the first."""
    return with_movement(bars).select(
        "symbol",
        "date",
        *[F.coalesce(name, F.lit(NO_HISTORY)).alias(name) for name in ["tr", "pdm1", "mdm1"]],
    )


def _from(first: int, value: Column) -> Column:
    return F.when(F.col("i") >= first, value).otherwise(NO_HISTORY)


def with_index(
    bars: DataFrame, block: int = BLOCK, more: dict[str, Column] | None = None
) -> DataFrame:
    """Add the directional columns to the bars; -1.0 where there is too little history."""
    # The 14-bar sums start from a plain sum and decay from there. All that is ordered by
    # date alone is computed here; from ``add_blocks`` on, rows stay in (_block, date) order.
    seeded = with_movement(bars, more).withColumns(
        {
            f"_{name}": F.when(F.col("i") < PERIOD, 0.0)
            .when(F.col("i") == PERIOD, F.sum(name).over(s.last_rows(PERIOD)))
            .otherwise(F.col(name))
            for name in ["tr", "pdm1", "mdm1"]
        }
    )
    seeded = add_blocks(seeded, "i", block)
    summed = add_decayed_sums(
        seeded,
        {"_tr14": F.col("_tr"), "_pdm14": F.col("_pdm1"), "_mdm14": F.col("_mdm1")},
        DECAY,
        block,
    )
    apart = F.abs(F.col("_pdm14") - F.col("_mdm14"))
    # The true range cancels out of the index; no movement at all counts as 0.
    strength = F.coalesce(F.try_divide(apart, F.col("_pdm14") + F.col("_mdm14")), F.lit(0.0)) * 100
    with_dx = summed.withColumn("_dx", F.when(F.col("i") >= PERIOD, strength).otherwise(0.0))

    # Ordered like the block windows, so the rows are not sorted again.
    by_block = Window.partitionBy("symbol").orderBy("_block", "date")
    start = F.avg("_dx").over(by_block.rowsBetween(1 - PERIOD, 0))
    averaged = add_decayed_sums(
        with_dx.withColumn(
            "_step",
            F.when(F.col("i") < FIRST_INDEX, 0.0)
            .when(F.col("i") == FIRST_INDEX, start)
            .otherwise(F.col("_dx") / PERIOD),
        ),
        {"_adx": F.col("_step")},
        DECAY,
        block,
    )

    def share(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(name), F.col("_tr14")), F.lit(0.0)) * 100

    plus, minus = share("_pdm14"), share("_mdm14")
    return averaged.withColumns(
        {
            "tr": F.coalesce("tr", F.lit(NO_HISTORY)),
            "pdm1": F.coalesce("pdm1", F.lit(NO_HISTORY)),
            "mdm1": F.coalesce("mdm1", F.lit(NO_HISTORY)),
            "tr14": _from(PERIOD, F.col("_tr14")),
            "pdm14": _from(PERIOD, F.col("_pdm14")),
            "mdm14": _from(PERIOD, F.col("_mdm14")),
            "pdi14": _from(PERIOD, plus),
            "mdi14": _from(PERIOD, minus),
            "di14diff": _from(PERIOD, F.abs(plus - minus)),
            "di14sum": _from(PERIOD, plus + minus),
            "dx": _from(PERIOD, F.col("_dx")),
            "adx": _from(FIRST_INDEX, F.col("_adx")),
        }
    ).select(*bars.columns, *(more or {}), "i", *DIRECTIONAL_VALUES)


def directional_index(bars: DataFrame, digits: int | None = 6, block: int = BLOCK) -> DataFrame:
    """The directional series; a symbol needs 28 bars. ``digits=None`` leaves values unrounded."""
    needed = bars.select("symbol", "date", "high", "low", "close").withColumn("_bars", s.length())
    rows = with_index(needed.where(F.col("_bars") > FIRST_INDEX), block)
    values = [
        F.col(name) if digits is None else F.round(name, digits).alias(name)
        for name in DIRECTIONAL_VALUES
    ]
    return rows.select("symbol", "date", *values)
