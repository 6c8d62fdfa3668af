"""Bars from order lines, with a supplier that holds a third of them, and the scratch folder."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from barloom import storage
from barloom.sources import market

LINES, DAYS = 30000, 7


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lines")
    hot = F.col("id") % 3 == 0
    spark.range(LINES).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"),
        ((F.col("id") * 31) % 977).alias("l_partkey"),
        F.when(hot, 1).otherwise(F.col("id") % 500 + 2).cast("bigint").alias("l_suppkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        ((F.col("id") * 7) % 1000 + 1).cast("double").alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"),
        F.date_add(F.lit(datetime.date(1999, 1, 1)), (F.col("id") % DAYS).cast("int"))
        .cast("timestamp_ntz")
        .alias("l_shipdate"),
    ).write.parquet(str(path / "lineitem.parquet"))
    return str(path)


def test_a_hot_supplier_has_one_bar_a_day(spark, folder):
    bars = market.bars(spark, folder)
    hot = bars.where("symbol = 'S1'").orderBy("date").collect()
    assert len(hot) == DAYS
    assert bars.count() == bars.select("symbol", "date").distinct().count()
    for k, bar in enumerate(hot):
        ids = [i for i in range(LINES) if i % 3 == 0 and i % DAYS == k]
        price = {i: ((i * 7) % 1000 + 1.0) / (i % 50 + 1.0) for i in ids}
        order = sorted(ids, key=lambda i: (i // 4, i % 4, (i * 31) % 977))
        assert bar["open"] == price[order[0]]
        assert bar["close"] == price[order[-1]]
        assert bar["adjclose"] == pytest.approx(price[order[-1]] * 0.9)
        assert (bar["high"], bar["low"]) == (max(price.values()), min(price.values()))
        assert bar["volume"] == sum(i % 50 + 1 for i in ids)


def test_hot_lines_are_combined_before_the_exchange(spark, folder):
    """The partial aggregate passes on one row per supplier, day and task, not the lines."""
    bars = market.bars(spark, folder)
    bars.collect()
    tasks = spark.read.parquet(f"{folder}/lineitem.parquet").rdd.getNumPartitions()
    keys = bars.count()
    partial = bars.sparkSession.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), F.spark_partition_id().alias("task")
    )
    sent = partial.distinct().where("l_suppkey = 1").count()
    assert sent <= DAYS * tasks < LINES / 3
    assert keys <= 501 * DAYS


def test_date_range(spark, folder):
    since, before = datetime.date(1999, 1, 3), datetime.date(1999, 1, 6)
    dates = market.bars(spark, folder, since, before).select("date").distinct().collect()
    assert sorted(r["date"].day for r in dates) == [3, 4, 5]


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, settings):
        self.sparkContext = FakeContext(master)
        self.conf = settings


def test_shared_folder_comes_from_the_session():
    named = FakeSession("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/"})
    assert storage.shared_folder(named) == "hdfs://nn/shared"
    # Where none is named, a folder in the warehouse, which is shared too, whatever the master.
    for master in ("yarn", "local[2]", "local-cluster[2,1,1024]"):
        unnamed = FakeSession(master, {"spark.sql.warehouse.dir": "hdfs://nn/warehouse"})
        assert storage.shared_folder(unnamed) == "hdfs://nn/warehouse/_scratch"


def test_scratch_tables_can_be_discarded(spark):
    stored = storage.materialize(spark.range(5), "numbers")
    assert stored.count() == 5
    path = stored._scratch
    storage.discard(stored)
    jvm = spark._jvm.org.apache.hadoop.fs
    assert not jvm.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path))


def test_numbers_beyond_the_packed_key_fail(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(3)
    lines.withColumn("l_linenumber", F.lit(10**6).cast("long")).write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="packed key"):
        market.bars(spark, str(tmp_path)).collect()
