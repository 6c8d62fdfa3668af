"""Table and file sinks. Nothing is collected: every sink is a distributed write."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import storage
from barloom.sinks import records

#: What a table was called while its next rows were written, by earlier versions of this library.
BESIDE = "__next"
#: Versions of a replaced table that are kept: readers that began before a replacement still find their files.
KEEP_VERSIONS = 2
#: The column that tables are partitioned by.
PART = "par"


def in_files(df: DataFrame, files: int | None) -> DataFrame:
    """Spread the rows evenly over ``files`` output files (a round-robin exchange)."""
    return df if files is None else df.repartition(files)


class Staged(NamedTuple):
    """Rows written for a table, which count once they are published, and the record they come after."""

    version: records.Version
    after: int


def replace_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    files: int | None = None,
    buckets: int | None = None,
    part: str | None = None,
) -> None:
    """Replace the whole table; ``df`` may read it.

    The rows are written once, as a new version in a folder of its own (below ``path`` if given); a commit
    record then makes it the one that counts (``records``), and the catalog follows. An end at any point
    leaves the old rows or the new ones.
    ``buckets`` lays the rows out by ``symbol``, sorted by date, so that window passes over
    the table need no exchange; the number of files follows from it. ``part`` names a column to
    partition by, for tables that grow by ``merge_partitions``.
    """
    publish(df.sparkSession, name, staged(df, name, fmt, path, files, buckets, part))


def staged(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    files: int | None = None,
    buckets: int | None = None,
    part: str | None = None,
) -> Staged:
    """Write the next version of a table; nothing reads it before it is published."""
    if files is not None and (buckets is not None or part is not None):
        raise ValueError("the number of files follows from buckets and partitions")
    spark = df.sparkSession
    recover(spark, name)
    after = records.last_number(spark, name)
    writer = _dealt(in_files(df, files), buckets, part).write.format(fmt)
    if buckets is not None:
        writer = writer.bucketBy(buckets, "symbol").sortBy("symbol", "date")
    if part is not None:
        writer = writer.partitionBy(part)
    return Staged(_written(spark, writer, name, records.fresh_folder(spark, name, path), fmt, buckets, part), after)


def _dealt(df: DataFrame, buckets: int | None, part: str | None) -> DataFrame:
    """The rows dealt out so that files are few: a task a bucket, or tasks of even size that share no small partition."""
    if buckets is not None:
        return df.repartition(buckets, "symbol")
    return df if part is None else df.hint("rebalance", part)


def publish(spark: SparkSession, name: str, written: Staged) -> None:
    """Make staged rows the table: the commit record, then the catalog, then versions that are too old go."""
    records.commit(spark, name, written.version, written.after)
    _follow(spark, name, written.version)
    records.prune(spark, name, KEEP_VERSIONS)


def _written(
    spark: SparkSession, writer, name: str, folder: str, fmt: str, buckets: int | None, part: str | None
) -> records.Version:
    """The rows in ``folder``, under a passing name as only tables can have buckets."""
    passing = _passing(name)
    writer.option("path", folder).mode("error").saveAsTable(passing)
    schema = spark.read.table(passing).schema
    spark.sql(f"DROP TABLE {passing}")  # the files of a table with a path stay
    return records.Version(folder, fmt, schema, buckets, part)


def _passing(name: str) -> str:
    return f"{name}__{uuid.uuid4().hex}"


def _follow(spark: SparkSession, name: str, version: records.Version) -> None:
    """Point the catalog to a version; in one step where only the place differs."""
    if spark.catalog.tableExists(name):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        rows = {r["col_name"]: r["data_type"] for r in described}
        # The last part of a version's folder is unique; the rest is spelled differently by some stores.
        if (rows.get("Location") or "").rpartition("/")[2] == version.location.rpartition("/")[2]:
            return
        if version.part is None and _shape_of(spark, name, rows) == _shape(version):
            spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(version.location)}")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _create(spark, name, version)


def _create(spark: SparkSession, name: str, version: records.Version) -> None:
    if version.buckets is None and version.part is None:
        spark.catalog.createTable(name, version.location, version.fmt, version.schema)
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in version.schema.fields)
    layout = f"PARTITIONED BY (`{version.part}`) " if version.part else ""
    if version.buckets:
        layout += f"CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {version.buckets} BUCKETS "
    # Under a passing name until its partitions are known: the table appears whole.
    passing = _passing(name)
    spark.sql(f"CREATE TABLE {passing} ({columns}) USING {version.fmt} {layout}LOCATION {_quoted(version.location)}")
    if version.part:
        spark.catalog.recoverPartitions(passing)
    spark.sql(f"ALTER TABLE {passing} RENAME TO {name.rpartition('.')[2]}")


def _shape(version: records.Version) -> tuple:
    return ("EXTERNAL", version.fmt, version.buckets, [(f.name, f.dataType) for f in version.schema.fields])


def _shape_of(spark: SparkSession, name: str, rows: dict[str, str]) -> tuple:
    """Kind, format, buckets and columns of a catalog table, from its description."""
    columns = [(f.name, f.dataType) for f in spark.read.table(name).schema.fields]
    buckets = rows.get("Num Buckets")
    return (rows.get("Type"), (rows.get("Provider") or "").lower(), int(buckets) if buckets else None, columns)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recover(spark: SparkSession, name: str) -> None:
    """Bring the catalog in line with the newest commit record and finish a merge, whatever was cut off before.

    Without a record, finish what an earlier version of this library began: its switch renamed a table.
    """
    if version := records.current(spark, name):
        _follow(spark, name, version)
        if rows := records.open_merge(spark, name):
            _finish_merge(spark, name, rows)
    elif not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}{BESIDE}"):
        spark.sql(f"ALTER TABLE {name}{BESIDE} RENAME TO {name.rpartition('.')[2]}")


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a table with its records and versions. After a plain DROP TABLE the record would bring it back."""
    records.forget(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def merge_partitions(
    delta: DataFrame,
    name: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    part: Column,
    buckets: int | None = None,
) -> None:
    """Merge rows into a table partitioned by ``part`` of a row; partitions that get no row aren't read or written.

    ``merge(old, delta)`` gives the new rows of the partitions that ``delta`` falls in; rows without a partition are left
    out. These are written beside the table and noted, and then take the partitions' places. If the
    driver ends in between, the next to open the table (``recover``) puts them in place again, so the old rows are found
    or all new ones. A table that isn't there, or isn't partitioned so, is written as a whole, once. The list of touched
    partitions is the driver's: choose days, months or years, not symbols.
    """
    spark = delta.sparkSession
    recover(spark, name)
    stored = storage.materialize(delta.withColumn(PART, part).where(F.col(PART).isNotNull()), "delta")
    rows, version = stored.drop(PART), records.current(spark, name)
    if version is None or version.part != PART:
        if spark.catalog.tableExists(name):
            old = spark.read.table(name)
            rows = merge(old, rows)
        else:
            rows = merge(rows.limit(0), rows)
        replace_table(rows.withColumn(PART, part), name, buckets=buckets, part=PART)
        return
    touched = [r[0] for r in stored.select(PART).distinct().collect()]
    if not touched:
        return
    old = spark.read.table(name).where(F.col(PART).isin(touched)).drop(PART)
    columns = [f.name for f in version.schema.fields]
    merged = merge(old, rows).withColumn(PART, part).select(*columns)
    folder = f"{records.home(spark, name)}/m-{uuid.uuid4().hex}"
    merged.write.parquet(folder)
    records.begin_merge(spark, name, folder)
    _finish_merge(spark, name, folder)


def _finish_merge(spark: SparkSession, name: str, folder: str) -> None:
    """Put the rows of a merge in their partitions' places; doing so twice is the same as once."""
    version = records.current(spark, name)
    rows = spark.read.schema(version.schema).parquet(folder)
    with _dynamic_overwrite(spark):
        _dealt(rows, version.buckets, version.part).write.mode("overwrite").insertInto(name)
    records.end_merge(spark, name)
    storage.remove(spark, folder)


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Overwriting a table replaces only the partitions that get rows. A writer's option doesn't reach a table."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def write_table(
    df: DataFrame, name: str, overwrite: bool = True, fmt: str = "orc", path: str | None = None
) -> None:
    """ORC table: replaced with the schema of ``df``, or appended to (made if it does not exist)."""
    spark = df.sparkSession
    recover(spark, name)
    if overwrite or not spark.catalog.tableExists(name):
        replace_table(df, name, fmt, path)
    else:
        df.write.format(fmt).mode("append").saveAsTable(name)


def write_partition(df: DataFrame, name: str, value: str, fmt: str = "orc") -> None:
    """Replace the partition ``par=value`` of a partitioned table, made if it does not exist; the others stay."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        empty = df.withColumn(PART, F.lit(value)).limit(0)
        empty.write.format(fmt).partitionBy(PART).saveAsTable(name)
    columns = [c for c in spark.read.table(name).columns if c != PART]
    names = ", ".join(f"`{c}`" for c in columns)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION ({PART} = {_quoted(value)}) SELECT {names} FROM {{rows}}",
        rows=df.select(*columns),
    )


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    in_files(df, files).write.mode("overwrite").option("sep", "\t").csv(path)


def export_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """CSV with a header in global order: the file names sort like the rows."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_daily_feed(bars: DataFrame, path: str) -> None:
    """Feed files ``path/symbol=<symbol>/*.csv`` in the layout the feed reader takes."""
    feed = bars.select(
        "symbol",
        F.col("date").alias("Date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
        F.col("adjclose").alias("AdjClose"),
    )
    # A symbol's rows meet in one task, which writes its file; otherwise every task writes one for every symbol.
    feed.repartition("symbol").write.mode("overwrite").option("header", True).partitionBy("symbol").csv(path)


def write_universe(universe: DataFrame, path: str) -> None:
    """Universe list with records ended by a bare carriage return."""
    universe.write.mode("overwrite").option("header", True).option("lineSep", "\r").csv(path)


def write_labeled_points(points: DataFrame, path: str) -> None:
    """``label, features`` (vector) as libsvm text, replacing what is there."""
    points.select("label", "features").write.mode("overwrite").format("libsvm").save(path)


def ddl(df: DataFrame) -> str:
    """Column definitions of ``df``, as a CREATE TABLE statement takes them."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """Replace ``target`` with the rows of ``source``."""
    replace_table(spark.read.table(source), target)


def name_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
