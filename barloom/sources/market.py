"""Bars, benchmark and universe derived from the order-line tables.

A supplier plays the role of a symbol and its ship dates are trading days. All
three start with a map-side-combined aggregate, so a supplier or a day holding
a large share of the lines is reduced to one row a day before it is shuffled.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order, line and part number as one decimal. Lines of an order stay below 10^6 and
# part numbers below 10^12; larger ones fail the job.
KEY = "decimal(19,0)"
LINE_STEP = 10**12
ORDER_STEP = 10**18
LINE_LIMIT = 10**6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _days(
    df: DataFrame, column: str, since: datetime.date | None, before: datetime.date | None
) -> DataFrame:
    """Rows of a date range, compared in the stored type so that the scan can skip row groups."""
    stored = df.schema[column].dataType
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(stored))
    if before is not None:
        df = df.where(F.col(column) < F.lit(before).cast(stored))
    return df


def bars(
    spark: SparkSession,
    folder: str,
    since: datetime.date | None = None,
    before: datetime.date | None = None,
) -> DataFrame:
    """One bar per (supplier, ship date): the price is the unit price of a line.

    Open and close are the first and last line by (order, line, part), packed into
    one decimal: fixed-width aggregate state lets Spark hash the lines into days
    instead of sorting them, and the numeric key is cheaper than the label.
    """
    fits = (F.col("l_linenumber") < LINE_LIMIT) & (F.col("l_partkey") < LINE_STEP)
    checked = F.when(fits, F.col("l_orderkey")).otherwise(
        F.raise_error(F.lit("a line or part number does not fit the packed key"))
    )
    packed = checked.cast(KEY) * F.lit(ORDER_STEP).cast(KEY) + (
        F.col("l_linenumber") * F.lit(LINE_STEP) + F.col("l_partkey")
    ).cast(KEY)
    lines = _days(table(spark, folder, "lineitem"), "l_shipdate", since, before).select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
        "l_discount",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        packed.alias("at"),
    )
    days = lines.groupBy("l_suppkey", "date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.max_by("l_discount", "at").alias("discount"),
    )
    return days.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        (F.col("close") * (1 - F.col("discount"))).alias("adjclose"),
    )


def line_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The unit price of every order line, as ``symbol, date, close``; a day may have several."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
    )


def benchmark(
    spark: SparkSession,
    folder: str,
    since: datetime.date | None = None,
    before: datetime.date | None = None,
) -> DataFrame:
    """One bar per order date for the single symbol ``SPX``."""
    orders = _days(table(spark, folder, "orders"), "o_orderdate", since, before).select(
        F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice"
    )
    days = orders.groupBy("date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return days.select(
        F.lit("SPX").alias("symbol"),
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("close").alias("adjclose"),
    )


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that should have bars, with name and sector."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
            F.concat(F.lit("N"), F.col("s_nationkey")).alias("code"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
        )
    )
