"""Scans of landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.sinks import tables

EXTRA = "_extra"


def _feed(spark: SparkSession, path: str, partition: str | None, files: list[str] | None = None) -> DataFrame:
    """The feed fields as text, with one field more to notice lines that are too long; of all files or of some."""
    names = [*schemas.FEED_FIELDS, EXTRA, *([partition] if partition else [])]
    return (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("basePath", path)
        .csv(path if files is None else files)
    )


def _typed(name: str) -> Column:
    """A feed field in its bar type; NULL when the text does not cast."""
    return F.col(name).try_cast(schemas.BAR[name.lower()].dataType)


def _is_whole() -> Column:
    """All seven fields cast and there is no eighth.

    Tested on every field, so the answer does not depend on which columns are read later.
    """
    whole = F.col(EXTRA).isNull()
    for name in schemas.FEED_FIELDS:
        whole &= _typed(name).isNotNull()
    return whole


def _as_bars(feed: DataFrame, symbol: Column) -> DataFrame:
    fields = [_typed(name).alias(name.lower()) for name in schemas.FEED_FIELDS]
    return feed.where(_is_whole()).select(symbol.alias("symbol"), *fields)


def read_daily_feed(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Bars from ``path/symbol=<symbol>/*.csv``, or from some of these files; lines that do not parse are left out."""
    if files is not None and not files:
        return spark.createDataFrame([], schemas.BAR)
    return _as_bars(_feed(spark, path, "symbol", files), F.col("symbol"))


def read_symbol_feed(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one symbol from plain feed files, e.g. the calendar or the benchmark."""
    return _as_bars(_feed(spark, path, None), F.lit(symbol))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``read_daily_feed`` leaves out: symbol and text."""
    line = F.concat_ws(",", *schemas.FEED_FIELDS, EXTRA)
    return _feed(spark, path, "symbol").where(~_is_whole()).select("symbol", line.alias("line"))


def read_bar_lines(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """Bars from text lines ``symbol,date,open,high,low,close,volume,adjclose``.

    For many symbols in few files, where a folder per symbol would be too many.
    Fields are trimmed and cast; lines of another width or with a field that
    does not cast are left out. ``files`` names some of the files below ``path``.
    """
    if files is not None and not files:
        return spark.createDataFrame([], schemas.BAR)
    parts = spark.read.text(path if files is None else files).select(F.split("value", ",").alias("part"))
    names = ["symbol", "date", *schemas.BAR_VALUES]
    typed = parts.where(F.size("part") == len(names)).select(
        *[
            F.trim(F.get("part", F.lit(i))).try_cast(schemas.BAR[name].dataType).alias(name)
            for i, name in enumerate(names)
        ]
    )
    return typed.dropna(how="any")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A universe list: comma-separated, header, records ended by a bare carriage return."""
    return (
        spark.read.schema(schemas.UNIVERSE)
        .option("header", True)
        .option("lineSep", "\r")
        .csv(path)
    )


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_labeled_points(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``label, features`` from libsvm files; name the ``width`` to save a pass over them."""
    reader = spark.read.format("libsvm")
    if width is not None:
        reader = reader.option("numFeatures", width)
    return reader.load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table ``name``; created empty with ``schema`` if there is none yet.

    A replacement that was cut off is finished first, so the rows it committed are never taken for missing.
    """
    tables.recover(spark, name)
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format(fmt).saveAsTable(name)
    return spark.read.table(name)
