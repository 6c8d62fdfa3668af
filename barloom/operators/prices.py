"""Price adjustment, normalisation and relative strength."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.functions.scalars import positive

SCALE = 10000
VOLUME_OFFSET = 1e-5


def adjust(bars: DataFrame, since: datetime.date | None = None) -> DataFrame:
    """Carry the adjustment of the close over to open, high and low."""
    if since is not None:
        bars = bars.where(F.col("date") >= F.lit(since))
    factor = F.try_divide("adjclose", "close")
    return bars.withColumns({f"adj{name}": factor * F.col(name) for name in ["open", "high", "low"]})


def normalize(adjusted: DataFrame) -> DataFrame:
    """Add prices relative to the first adjusted close of the series."""
    first = F.first("adjclose").over(s.so_far())
    based = adjusted.withColumn("normclose", F.try_divide(F.col("adjclose"), first))
    factor = F.try_divide("normclose", "adjclose")
    return based.withColumns(
        {f"norm{name}": factor * F.col(f"adj{name}") for name in ["open", "high", "low"]}
    )


def benchmark_values(benchmark: DataFrame, symbol: str = "SPX") -> DataFrame:
    """The benchmark's open per date, from its second bar on, with its bar as ``spx*``.

    Grouped by date, so there is at most one row a day and the result may be
    broadcast: a century of days is some 36,500 rows.
    """
    of_symbol = benchmark.where(F.col("symbol") == symbol)
    first = of_symbol.agg(F.min("date")).scalar()
    names = ["open", "high", "low", "close", "volume"]
    by_day = of_symbol.groupBy("date").agg(F.max(F.struct(*names)).alias("_bar"))
    return by_day.where(F.col("date") > first).select(
        "date",
        F.col("_bar.open").alias("value"),
        *[F.col(f"_bar.{name}").alias(f"spx{name}") for name in names],
    )


def relative(adjusted: DataFrame, values: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Prices as ten-thousandths of the benchmark; dates without a value drop out.

    ``values`` comes from ``benchmark_values`` (one row a day, broadcast).
    ``carry`` names further columns of either side to keep.
    """
    joined = adjusted.join(F.broadcast(values), "date")
    close = F.col("adjclose") / positive(F.col("value"), "benchmark value") * SCALE
    scaled = joined.withColumn("_close", close).withColumn(
        "_factor", F.try_divide("_close", "adjclose")
    )
    return scaled.select(
        "symbol",
        "date",
        *[(F.col("_factor") * F.col(f"adj{name}")).alias(name) for name in ["open", "high", "low"]],
        F.col("_close").alias("close"),
        F.lit(0.0).alias("volume"),
        *carry,
    )


def relative_ratios(adjusted: DataFrame, index: DataFrame) -> DataFrame:
    """Each adjusted field over the same field of an index with ``norm*`` columns.

    ``index`` has one row a day (see ``indexes.mean_index``); grouping it by date here makes sure
    of it, so it may be broadcast.
    """
    by_day = index.groupBy("date").agg(
        *[F.max(f"norm{name}").alias(f"_{name}") for name in ["open", "high", "low", "close"]],
        F.max("volume").alias("_volume"),
    )
    joined = adjusted.join(F.broadcast(by_day), "date")
    return joined.select(
        "symbol",
        "date",
        *[
            (F.try_divide(F.col(f"adj{name}"), F.col(f"_{name}")) * SCALE).alias(f"rlt{name}")
            for name in ["open", "high", "low", "close"]
        ],
        (F.col("volume") / (F.col("_volume") + VOLUME_OFFSET) * SCALE).alias("rltvolume"),
    )
