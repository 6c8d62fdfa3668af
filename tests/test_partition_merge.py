"""Merging a few days into a long history."""

from __future__ import annotations

import uuid

import pytest
from helpers import by_key, frame, random_walk
from pyspark.sql import functions as F
from test_records import Killed, killed_at, torn

from barloom import storage
from barloom.operators import ingest
from barloom.plans import stages as st
from barloom.sinks import records, tables


def month():
    return F.date_format("date", "yyyy-MM")


@pytest.fixture()
def name(spark):
    name = f"merged_{uuid.uuid4().hex[:8]}"
    yield name
    tables.drop_table(spark, name)


@pytest.fixture(scope="module")
def history(spark):
    return storage.materialize(frame(spark, random_walk("A", 400) + random_walk("B", 380)), "history")


@pytest.fixture(scope="module")
def delta(spark, history):
    """Some bars of the last month again, with another volume, and some of a month that isn't there yet."""
    late = history.where("date >= '1991-01-25'").withColumn("volume", F.lit(-1.0))
    return storage.materialize(late.union(frame(spark, random_walk("A", 410)).where("date >= '1991-02-04'")), "delta")


def files(spark, name):
    rows = spark.read.table(name).select(tables.PART, "_metadata.file_path", "_metadata.file_modification_time").distinct()
    return {(r["par"], r["file_path"], r["file_modification_time"]) for r in rows.collect()}


def bars(spark, name):
    tables.recover(spark, name)
    return by_key(spark.read.table(name).drop(tables.PART))


@pytest.mark.parametrize("buckets", [None, 3])
def test_only_touched_partitions_are_written(spark, name, history, delta, buckets):
    tables.merge_partitions(history, name, ingest.merge_bars, month(), buckets)
    before = files(spark, name)
    tables.merge_partitions(delta, name, ingest.merge_bars, month(), buckets)
    after = files(spark, name)
    touched = {r[0] for r in delta.select(month()).distinct().collect()}
    assert touched == {"1991-01", "1991-02"}
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert not {f[1] for f in before if f[0] in touched} & {f[1] for f in after}
    assert bars(spark, name) == by_key(ingest.merge_bars(history, delta))
    assert len({f[0] for f in after}) == 14


def test_the_scan_of_old_rows_is_pruned(spark, name, history, delta):
    tables.merge_partitions(history, name, ingest.merge_bars, month())
    seen = []

    def merge(old, rows):
        seen.append(old)
        return ingest.merge_bars(old, rows)

    tables.merge_partitions(delta.where("date < '1991-02-01'"), name, merge, month())
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(par" in plan and "(par#" in plan.split("PartitionFilters")[1]
    assert {r[0] for r in seen[0].select(month()).distinct().collect()} == {"1991-01"}


def test_merging_twice_or_nothing_changes_nothing(spark, name, history, delta):
    tables.merge_partitions(history, name, ingest.merge_bars, month())
    tables.merge_partitions(delta, name, ingest.merge_bars, month())
    expected, before = bars(spark, name), files(spark, name)
    tables.merge_partitions(delta.limit(0), name, ingest.merge_bars, month())
    assert files(spark, name) == before
    tables.merge_partitions(delta.withColumn("date", F.lit(None).cast("date")), name, ingest.merge_bars, month())
    assert files(spark, name) == before
    tables.merge_partitions(delta, name, ingest.merge_bars, month())
    assert bars(spark, name) == expected


STEPS = [
    ("rows aren't noted", lambda m: killed_at(m, records, "begin_merge"), False),
    ("half the note is written", lambda m: m.setattr(storage, "write_new", torn), False),
    ("rows are noted", lambda m: killed_at(m, records, "begin_merge", after=True), True),
    ("partitions are replaced, the note is there", lambda m: killed_at(m, records, "end_merge"), True),
    ("the note has gone", lambda m: killed_at(m, records, "end_merge", after=True), True),
]


@pytest.mark.parametrize(("kill", "merged"), [s[1:] for s in STEPS], ids=[s[0] for s in STEPS])
def test_an_end_leaves_the_old_rows_or_the_merged_ones(spark, monkeypatch, name, history, delta, kill, merged):
    tables.merge_partitions(history, name, ingest.merge_bars, month())
    with monkeypatch.context() as patch:
        kill(patch)
        with pytest.raises(Killed):
            tables.merge_partitions(delta, name, ingest.merge_bars, month())
    whole = ingest.merge_bars(history, delta)
    assert bars(spark, name) == by_key(whole if merged else history)
    tables.merge_partitions(delta, name, ingest.merge_bars, month())
    assert bars(spark, name) == by_key(whole)


def test_partitions_that_were_half_replaced_are_replaced_again(spark, name, history, delta):
    tables.merge_partitions(history, name, ingest.merge_bars, month())
    version = records.current(spark, name)
    whole = ingest.merge_bars(history, delta)
    folder = f"{records.home(spark, name)}/m-test"
    whole.withColumn("par", month()).where("par >= '1991-01'").select(*version.schema.names).write.parquet(folder)
    records.begin_merge(spark, name, folder)
    storage.remove(spark, f"{version.location}/par=1991-01")  # as far as the job came
    assert bars(spark, name) == by_key(whole)
    with pytest.raises(records.Conflict):
        records.begin_merge(spark, name, folder)
        records.begin_merge(spark, name, folder)
    records.end_merge(spark, name)


def test_a_lost_catalog_finds_all_partitions(spark, name, history):
    tables.merge_partitions(history, name, ingest.merge_bars, month(), 2)
    spark.sql(f"DROP TABLE {name}")
    assert bars(spark, name) == by_key(history)


def test_a_plain_table_is_taken_over_once(spark, name, history, delta):
    tables.replace_table(history, name)
    tables.merge_partitions(delta, name, ingest.merge_bars, month())
    assert bars(spark, name) == by_key(ingest.merge_bars(history, delta))
    assert records.current(spark, name).part == tables.PART


def test_the_daily_job_merges_years(spark, history, delta):
    job = st.Stages(spark, buckets=2, yearly=True)
    for name, rows in [(st.BARS, history), (st.DELTA, delta)]:
        tables.drop_table(spark, name)
        tables.replace_table(rows, name)
    try:
        job.merge()
        job.merge()
        assert by_key(job.table(st.BARS)) == by_key(ingest.merge_bars(history, delta))
        assert job.table(st.BARS).columns == history.columns
        assert {r[0] for r in spark.read.table(st.BARS).select(tables.PART).distinct().collect()} == {1990, 1991}
    finally:
        for name in (st.BARS, st.DELTA):
            tables.drop_table(spark, name)
