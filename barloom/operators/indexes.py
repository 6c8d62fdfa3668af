"""Market indexes and breadth: one row per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import series as s

MEAN_INDEX = "IDXBIN"
MEDIAN_INDEX = "IDXBIN2"

# Histogram cells per factor e of the value: a day's values that share a cell
# lie within 0.006 % of each other.
CELLS = 16384
LOWEST_CELL = -(2**40)


def mean_index(normalized: DataFrame) -> DataFrame:
    """Equal-weight mean of the normalised prices and the volume per date."""
    names = ["normopen", "normhigh", "normlow", "normclose", "volume"]
    return (
        normalized.groupBy("date")
        .agg(*[F.avg(name).alias(name) for name in names])
        .select(F.lit(MEAN_INDEX).alias("symbol"), "date", *names)
    )


def day_returns(bars: DataFrame, price: str) -> DataFrame:
    """Bars with ``relclose``, the day-over-day ratio of ``price``; NULL on the first bar."""
    return bars.withColumn("relclose", s.change(price))


def exact_median(values: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of ``value`` per ``group`` without gathering a group.

    Equal values are counted together, a histogram per group locates the cells
    that hold the two middle ranks, and only those cells are sorted. ``group``
    must have few distinct values (dates): two histogram rows of each are
    broadcast.
    """
    cell = F.coalesce(F.floor(F.ln(value) * CELLS), F.lit(LOWEST_CELL))
    counted = (
        values.where(F.col(group).isNotNull() & F.col(value).isNotNull())
        .select(F.col(group), cell.alias("cell"), F.col(value).alias("value"))
        .groupBy(group, "cell", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )

    cells = counted.groupBy(group, "cell").agg(F.sum("copies").alias("size"))
    up_to_here = Window.partitionBy(group).orderBy("cell")
    whole = up_to_here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = cells.select(
        group,
        "cell",
        (F.sum("size").over(up_to_here) - F.col("size")).alias("below"),
        "size",
        F.sum("size").over(whole).alias("total"),
    )
    low = F.floor((F.col("total") - 1) / 2)
    high = F.floor(F.col("total") / 2)
    middle = (
        ranked.select(group, "cell", "below", "size", low.alias("low"), high.alias("high"))
        .where((F.col("low") < F.col("below") + F.col("size")) & (F.col("high") >= F.col("below")))
        .drop("size")
    )

    in_cell = Window.partitionBy(group, "cell").orderBy("value")
    placed = counted.join(F.broadcast(middle), [group, "cell"]).withColumn(
        "after", F.col("below") + F.sum("copies").over(in_cell)
    )
    before = F.col("after") - F.col("copies")

    def at(rank: str):
        return F.max(F.when((before <= F.col(rank)) & (F.col(rank) < F.col("after")), F.col("value")))

    return placed.groupBy(group).agg(((at("low") + at("high")) / 2).alias(value))


def median_index(normalized: DataFrame) -> DataFrame:
    """Running product of the median day-over-day return, 1.0 on the first date.

    The product runs over one row per date, so its single partition is bounded
    by the calendar.
    """
    traded = normalized.where(F.col("volume") > 0)
    returns = day_returns(traded, "normclose").select(
        "date", F.coalesce("relclose", F.lit(1.0)).alias("relclose")
    )
    steps = exact_median(returns, "date", "relclose").select(
        F.lit(MEDIAN_INDEX).alias("symbol"), "date", "relclose"
    )
    factor = F.when(s.position() == 0, 1.0).otherwise(F.col("relclose"))
    return (
        steps.withColumn("_factor", factor)
        .withColumn("close", F.product("_factor").over(s.so_far()))
        .select("symbol", "date", "close")
    )


def breadth(bars: DataFrame) -> DataFrame:
    """Per date, how many symbols rose or held (``pos``) and fell (``neg``) since their last bar."""
    moved = day_returns(bars, "close").where(F.col("relclose").isNotNull())
    return moved.groupBy("date").agg(
        F.count_if(F.col("relclose") >= 1).alias("pos"),
        F.count_if(F.col("relclose") < 1).alias("neg"),
    )


def breadth_over(bars: DataFrame, days: int = 5) -> DataFrame:
    """Breadth over ``days`` bars: above 1 is positive, the rest negative, no history neither."""
    ratio = bars.select("date", s.change("close", days).alias("diffclose"))
    return ratio.groupBy("date").agg(
        F.sum(F.when(F.col("diffclose") > 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("diffclose") <= 1, 1).otherwise(0)).alias("neg"),
    )
