"""Which landed files have been taken.

A ledger is a table of files, each with its size and time. What stands in a landing folder and not in the
ledger is new: a file that came late, whatever dates it holds, or one that was written again. Only new files are
opened. A run takes them in three steps that may each be repeated: read them, use their bars (a keyed
merge, so reading a file twice does no harm), and then note them in the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sinks import tables
from barloom.sources import landing

FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)
KEY = [f.name for f in FILE.fields]


def landed(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of the files below a folder; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select("path", "length", F.col("modificationTime").alias("modified"))


def new_files(files: DataFrame, taken: DataFrame) -> DataFrame:
    """The landed files that the ledger ``taken`` doesn't have as they are now."""
    return files.join(taken, KEY, "left_anti")


def read(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    reader: Callable[[SparkSession, str, list[str]], DataFrame] = landing.read_daily_feed,
) -> DataFrame:
    """The bars of ``files`` below ``path``. Their names pass through the driver, as in every listing of Spark's."""
    return reader(spark, path, [r["path"] for r in files.select("path").collect()])


def note(files: DataFrame, name: str) -> None:
    """Add files to the ledger ``name``, those that it doesn't have yet."""
    taken = landing.ensure_table(files.sparkSession, name, FILE)
    tables.write_table(new_files(files, taken), name, overwrite=False, fmt="parquet")
