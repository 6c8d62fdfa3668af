"""Dense symbol ids and the feature mart."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.operators import averages, breakouts, directional, prices
from barloom.storage import materialize

# monotonically_increasing_id: partition number above, row number in the lower 33 bits.
ROW_BITS = 33


def symbol_ids(bars: DataFrame) -> DataFrame:
    """``symbol, id, id_num``: 0-based rank among the sorted distinct symbols, and their number.

    The symbols are range-partitioned and sorted in parallel; a rank is the
    number of symbols in earlier partitions plus the place in its own. The
    placed symbols are written once, so that both uses see the same ranges.
    """
    placed = materialize(
        bars.select("symbol")
        .distinct()
        .repartitionByRange("symbol")
        .sortWithinPartitions("symbol")
        .withColumn("_at", F.monotonically_increasing_id()),
        "symbols",
    ).select(
        "symbol",
        F.shiftright("_at", ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )
    # One row per partition, however many symbols there are.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("_part")
    parts = sizes.select(
        "_part",
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_before"),
        F.sum("_size")
        .over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("id_num"),
    )
    return placed.join(F.broadcast(parts), "_part").select(
        "symbol", (F.col("_before") + F.col("_row")).alias("id"), "id_num"
    )


def _by_symbol(bars: DataFrame) -> DataFrame:
    """Bars dealt out by symbol in as many parts as shuffles have.

    The passes over a series take far more time than its few bytes suggest: parts that Spark joins by their size are
    one more than there are cores, and the last of them runs alone.
    """
    return bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")


def rated_bars(
    bars: DataFrame,
    benchmark: DataFrame,
    fast: int = 8,
    slow: int = 20,
    since: datetime.date | None = None,
) -> DataFrame:
    """Relative bars with average ratio, directional index, gap-up label and benchmark.

    Raw bars are exchanged on ``symbol`` once. The gap-up label is taken on the raw
    series and carried along; the benchmark is broadcast; averages and the
    directional index are window passes over the same partitioning. Rows
    need a positive average ratio and a positive index. The relative series starts
    at ``since``; the gap-up label looks back over all bars.
    """
    flagged = breakouts.with_gap_up(_by_symbol(bars), "gupbreak")
    spx = ["spxopen", "spxhigh", "spxlow", "spxclose", "spxvolume"]
    values = prices.benchmark_values(benchmark)
    relative = prices.relative(prices.adjust(flagged, since), values, carry=["gupbreak", *spx])
    means = averages.average_columns({"_mat1": fast, "_mat2": slow})
    indexed = directional.with_index(relative, more=means).withColumn(
        "mat_dual",
        F.when(F.col("_mat2") > 0, F.try_divide("_mat1", "_mat2")),
    )
    return indexed.where((F.col("mat_dual") > 0) & (F.col("adx") > 0)).select(
        "symbol",
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "mat_dual",
        "adx",
        "pdi14",
        "mdi14",
        "gupbreak",
        *spx,
    )


def feature_mart(
    bars: DataFrame,
    benchmark: DataFrame,
    fast: int = 8,
    slow: int = 20,
    since: datetime.date | None = None,
) -> DataFrame:
    """``rated_bars`` with ``id`` and ``id_num`` of the symbols that have relative bars."""
    # One row a day on the broadcast side.
    days = F.broadcast(prices.benchmark_values(benchmark).select("date"))
    listed = bars if since is None else bars.where(F.col("date") >= F.lit(since))
    ids = symbol_ids(listed.join(days, "date", "left_semi"))
    return rated_bars(bars, benchmark, fast, slow, since).join(ids, "symbol", "left")
