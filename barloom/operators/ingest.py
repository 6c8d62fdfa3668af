"""Coverage, candidates, incremental landing and keyed merge of bars."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schemas import BAR_VALUES, SERIES_KEY

EARLIEST = datetime.date(1900, 1, 1)
COMPLETE_SINCE = datetime.date(2000, 1, 1)
SHORT_SYMBOLS_ALLOWED = 35


# A rank and a fingerprint share a long: the rank above, the fingerprint in the lower 62 bits.
FINGERPRINT_BITS = 62


def one_bar_per_day(bars: DataFrame) -> DataFrame:
    """Keep one bar per (symbol, date).

    An aggregate rather than a ranked window: copies of one key are combined
    before the shuffle and never gather in one task.
    """
    return _keep_highest(bars.withColumn("_rank", F.lit(0)))


def _keep_highest(ranked: DataFrame) -> DataFrame:
    """The bar of the highest ``_rank`` per key; a fingerprint of the values settles ties.

    All aggregate state has a fixed width, so Spark hashes and never sorts.
    """
    fingerprint = F.shiftrightunsigned(F.xxhash64(*BAR_VALUES), 64 - FINGERPRINT_BITS)
    order = F.shiftleft(F.col("_rank").cast("long"), FINGERPRINT_BITS) + fingerprint
    ordered = ranked.withColumn("_order", order)
    return ordered.groupBy(*SERIES_KEY).agg(
        *[F.max_by(name, "_order").alias(name) for name in BAR_VALUES]
    )


def merge_bars(history: DataFrame, delta: DataFrame) -> DataFrame:
    """Union of both with one bar per (symbol, date); the delta wins."""
    columns = [*SERIES_KEY, *BAR_VALUES]
    both = history.select(*columns, F.lit(0).alias("_rank")).unionByName(
        delta.select(*columns, F.lit(1).alias("_rank"))
    )
    valid = both.where((F.col("date") >= F.lit(EARLIEST)) & F.col("symbol").isNotNull())
    return _keep_highest(valid)


def date_spans(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """First and last bar date per universe symbol; NULL without bars."""
    spans = bars.groupBy("symbol").agg(
        F.max("date").alias("max_date"), F.min("date").alias("min_date")
    )
    tickers = universe.select(F.col("ticker").alias("symbol")).distinct()
    return tickers.join(spans, "symbol", "left")


def calendar_bounds(calendar: DataFrame) -> DataFrame:
    """One row: first and last date and the number of rows."""
    return calendar.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("bars"),
    )


def candidates(universe: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Symbols that lack the calendar's last date.

    A symbol that was never loaded gets the calendar's first date for both ends.
    """
    # One scan of the calendar gives both ends.
    ends = calendar.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    first, last = ends["first"], ends["last"]
    spans = date_spans(universe, bars)
    stale = spans.where(F.col("max_date").isNull() | (F.col("max_date") != last))
    return stale.select(
        "symbol",
        F.coalesce("max_date", first).alias("max_date"),
        F.coalesce("min_date", first).alias("min_date"),
    )


def new_bars(landed: DataFrame, stale: DataFrame) -> DataFrame:
    """Landed bars of candidate symbols from the day after their last bar."""
    since = stale.select("symbol", F.date_add("max_date", 1).alias("_since"))
    return landed.join(since, "symbol").where(F.col("date") >= F.col("_since")).drop("_since")


def may_replace(old: DataFrame, new: DataFrame) -> bool:
    """Whether a full refresh is allowed: it must not lose rows."""
    return new.count() >= old.count()


def refresh(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Write a full reload to a new ``path`` and return it; fails when it lost rows.

    The rows are counted as written, so ``new`` is computed once, and the old
    table is left alone either way.
    """
    new.write.mode("error").parquet(path)
    written = new.sparkSession.read.schema(new.schema).parquet(path)
    if not may_replace(old, written):
        raise ValueError("the reloaded series has fewer rows than the present one")
    return written


def latest_date(bars: DataFrame) -> DataFrame:
    """One row with the latest date."""
    return bars.select("date").orderBy(F.desc("date")).limit(1)


def coverage(bars: DataFrame) -> DataFrame:
    """Last date and number of bars per symbol, in symbol order."""
    return (
        bars.groupBy("symbol")
        .agg(F.max("date").alias("max_date"), F.count("date").alias("bars"))
        .orderBy("symbol")
    )


def short_symbols(
    bars: DataFrame, calendar: DataFrame, since: datetime.date = COMPLETE_SINCE
) -> DataFrame:
    """Symbols with fewer bars since ``since`` than the calendar has dates."""
    recent = F.col("date") >= F.lit(since)
    expected = calendar.where(recent).agg(F.count("date")).scalar()
    counts = bars.where(recent).groupBy("symbol").agg(F.count("date").alias("bars"))
    return counts.where(F.col("bars") < expected)


def completeness(
    bars: DataFrame,
    calendar: DataFrame,
    since: datetime.date = COMPLETE_SINCE,
    allowed: int = SHORT_SYMBOLS_ALLOWED,
) -> DataFrame:
    """One row: how many symbols are short, and whether that is tolerable."""
    return (
        short_symbols(bars, calendar, since)
        .agg(F.count(F.lit(1)).alias("short_symbols"))
        .withColumn("passed", F.col("short_symbols") <= allowed)
    )


def bar_slice(
    bars: DataFrame, symbol: str, first: datetime.date, last: datetime.date
) -> DataFrame:
    """Bars of one symbol in a closed date range."""
    return bars.where(
        (F.col("symbol") == symbol) & F.col("date").between(F.lit(first), F.lit(last))
    )


def calendar_parts(dates: DataFrame) -> DataFrame:
    """Parts of each distinct date, its weekday (Monday = 0) and the day after."""
    return dates.select("date").distinct().select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.weekday("date").alias("weekday"),
        F.date_add("date", 1).alias("next_day"),
    )
