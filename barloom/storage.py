"""Shared-folder scratch tables: the one place where lineage is cut.

Intermediate tables are written below the folder the session names in
``spark.checkpoint.dir``, which every executor can reach, so a lost executor
only costs the tasks it was running. Each driver process has a run folder there,
removed when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_cleared: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a folder in the warehouse, which is shared as well."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    run = f"{shared_folder(spark)}/barloom-{_RUN}"
    if run not in _cleared:
        _cleared.add(run)
        atexit.register(remove, spark, run)
    return f"{run}/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems; a session that has ended leaves it."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; fails if there is one already."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None where it can't be read whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except Py4JJavaError:
        return None


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    written._scratch = path
    return written


def discard(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    remove(df.sparkSession, df._scratch)
