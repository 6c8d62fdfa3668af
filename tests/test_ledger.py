"""Taking each landed file once."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from helpers import by_key, frame, random_walk
from pyspark.sql import functions as F
from test_records import Killed, killed_at

from barloom import storage
from barloom.operators import ingest
from barloom.plans import stages as st
from barloom.sinks import tables
from barloom.sources import landing, ledger

NAMES = [st.BARS, st.DELTA, st.FILES, st.TAKEN]
WALKS = {s: random_walk(s, 60) for s in ("A", "B", "C")}


def land(spark, folder, rows, mode="append"):
    """A feed file a symbol, beside those that are there."""
    feed = frame(spark, rows).select(
        "symbol", F.col("date").alias("Date"), *[F.col(n).alias(t) for n, t in zip(
            ["open", "high", "low", "close", "volume", "adjclose"], ["Open", "High", "Low", "Close", "Volume", "AdjClose"], strict=True)]
    )
    feed.repartition("symbol").write.mode(mode).option("header", True).partitionBy("symbol").csv(str(folder))


@pytest.fixture()
def job(spark):
    for name in NAMES:
        tables.drop_table(spark, name)
    job = st.Stages(spark)
    landing.ensure_table(spark, st.BARS, st.schemas.BAR)
    yield job
    for name in NAMES:
        tables.drop_table(spark, name)


def taken(job):
    return {Path(f).name for f in job.table(st.TAKEN).toPandas()["path"]}


def parts(folder):
    return {p.name for p in Path(folder).rglob("*.csv")}


def test_a_second_run_opens_no_old_file(spark, job, tmp_path):
    land(spark, tmp_path, WALKS["A"][:40] + WALKS["B"][:40])
    first = parts(tmp_path)
    job.take(str(tmp_path))
    assert taken(job) == first and by_key(job.table(st.DELTA)) == by_key(frame(spark, WALKS["A"][:40] + WALKS["B"][:40]))
    job.merge()
    job.take(str(tmp_path))
    assert taken(job) == set() and job.table(st.DELTA).count() == 0
    # A day later, and a file that comes late with old dates.
    land(spark, tmp_path, WALKS["A"][40:50] + WALKS["C"][:5])
    known = job.table(st.FILES)
    files = ledger.new_files(ledger.landed(spark, str(tmp_path)), known)
    opened = ledger.read(spark, str(tmp_path), files).inputFiles()
    assert {Path(f).name for f in opened} == parts(tmp_path) - first
    job.take(str(tmp_path))
    assert by_key(job.table(st.DELTA)) == by_key(frame(spark, WALKS["A"][40:50] + WALKS["C"][:5]))
    job.merge()
    assert by_key(job.table(st.BARS)) == by_key(frame(spark, WALKS["A"][:50] + WALKS["B"][:40] + WALKS["C"][:5]))


def test_two_runs_equal_one(spark, job, tmp_path):
    land(spark, tmp_path / "one", WALKS["A"] + WALKS["B"])
    job.take(str(tmp_path / "one"))
    job.merge()
    whole = by_key(job.table(st.BARS))
    for name in NAMES:
        tables.drop_table(spark, name)
    landing.ensure_table(spark, st.BARS, st.schemas.BAR)
    for rows in (WALKS["A"][30:] + WALKS["B"], WALKS["A"][:30]):
        land(spark, tmp_path / "two", rows)
        job.take(str(tmp_path / "two"))
        job.merge()
    assert by_key(job.table(st.BARS)) == whole


def test_a_file_written_again_is_taken_again(spark, job, tmp_path):
    land(spark, tmp_path, WALKS["A"][:10])
    job.take(str(tmp_path))
    job.merge()
    (file,) = tmp_path.rglob("*.csv")
    file.write_text(file.read_text() + "1999-01-01,1,2,0.5,1.5,10,1.5\n")
    os.remove(file.with_name(f".{file.name}.crc"))
    job.take(str(tmp_path))
    assert job.table(st.DELTA).count() == 11
    job.merge()
    assert job.table(st.BARS).count() == 11


@pytest.mark.parametrize("step", ["before merge", "before the note", "after the note", "within take"])
def test_a_run_that_ended_is_taken_up(spark, job, tmp_path, monkeypatch, step):
    land(spark, tmp_path, WALKS["A"][:10])
    job.take(str(tmp_path))
    job.merge()
    land(spark, tmp_path, WALKS["A"][10:20])
    with monkeypatch.context() as patch:
        if step == "before merge":
            killed_at(patch, ingest, "merge_bars")
        elif step == "within take":
            killed_at(patch, job, "_replace", calls=2)
        else:
            killed_at(patch, ledger, "note", after=step == "after the note")
        with pytest.raises(Killed):
            job.take(str(tmp_path))
            job.merge()
    if step == "within take":
        job.merge()  # the delta is there, its files are not listed yet: merged, but not noted
    job.take(str(tmp_path))
    again = job.table(st.DELTA).count()
    assert again == (0 if step == "after the note" else 10)
    job.merge()
    assert by_key(job.table(st.BARS)) == by_key(frame(spark, WALKS["A"][:20]))
    assert job.table(st.FILES).count() == 2
    job.take(str(tmp_path))
    assert job.table(st.DELTA).count() == 0


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "x.csv").write_text("abc")
    files = ledger.landed(spark, str(tmp_path))
    assert "content:binary" not in files._jdf.queryExecution().executedPlan().toString()
    assert [(r["length"], Path(r["path"]).name) for r in files.collect()] == [(3, "x.csv")]
    stored = storage.materialize(files, "files")
    assert ledger.new_files(files, stored).count() == 0
