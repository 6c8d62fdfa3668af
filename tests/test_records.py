"""Replacing a table whose driver may end at any step."""

from __future__ import annotations

import uuid

import pytest
from helpers import by_key, frame, random_walk
from pyspark.sql import functions as F

from barloom import schemas, storage
from barloom.plans.stages import Stages
from barloom.sinks import records, tables
from barloom.sources import landing


class Killed(BaseException):
    """The driver's end: nothing catches it."""


@pytest.fixture()
def name(spark):
    name = f"switched_{uuid.uuid4().hex[:8]}"
    yield name
    tables.drop_table(spark, name)


@pytest.fixture(scope="module")
def old(spark):
    return storage.materialize(frame(spark, random_walk("A", 40)), "old")


@pytest.fixture(scope="module")
def new(spark):
    return storage.materialize(frame(spark, random_walk("A", 50, seed=1) + random_walk("B", 20)), "new")


def killed_at(monkeypatch, module, function, after=False, calls=1):
    """Let the ``calls``-th call of a function end the driver, before it does anything or after."""
    real, seen = getattr(module, function), []

    def ending(*args, **named):
        seen.append(1)
        if len(seen) == calls and not after:
            raise Killed
        result = real(*args, **named)
        if len(seen) == calls:
            raise Killed
        return result

    monkeypatch.setattr(module, function, ending)


def torn(spark, path, text):
    """A record of which only the first half is written."""
    REAL_WRITE(spark, path, text[: len(text) // 2])
    raise Killed


REAL_WRITE = storage.write_new

STEPS = [
    ("nothing is written", lambda m: killed_at(m, tables, "_written"), "old"),
    ("rows are written", lambda m: killed_at(m, tables, "_written", after=True), "old"),
    ("before the record", lambda m: killed_at(m, storage, "write_new"), "old"),
    ("half the record is written", lambda m: m.setattr(storage, "write_new", torn), "old"),
    ("the record is written", lambda m: killed_at(m, storage, "write_new", after=True), "new"),
    ("before the catalog follows", lambda m: killed_at(m, tables, "_follow", calls=2), "new"),
    ("the catalog has no table", lambda m: killed_at(m, tables, "_create"), "new"),
    ("the catalog has followed", lambda m: killed_at(m, tables, "_follow", after=True, calls=2), "new"),
    ("before old versions go", lambda m: killed_at(m, records, "prune"), "new"),
    ("a version has gone, its record not", lambda m: killed_at(m, storage, "remove", after=True), "new"),
]
OPENED = [
    lambda spark, name: landing.ensure_table(spark, name, schemas.BAR),
    lambda spark, name: Stages(spark).table(name),
]


@pytest.mark.parametrize(("step", "kill", "found"), STEPS, ids=[s[0] for s in STEPS])
@pytest.mark.parametrize("widened", [False, True], ids=["same columns", "one more column"])
def test_an_end_leaves_old_rows_or_new_ones(spark, monkeypatch, name, old, new, step, kill, found, widened):
    tables.replace_table(new.limit(3), name)
    tables.replace_table(old, name)
    rows = new.withColumn("more", F.lit(1)) if widened else new
    with monkeypatch.context() as patch:
        kill(patch)
        try:
            tables.replace_table(rows, name)
            assert step == "the catalog has no table" and not widened  # there the catalog only changes its place
        except Killed:
            pass
    expected = by_key(rows if found == "new" else old)
    for opened in OPENED:
        assert by_key(opened(spark, name)) == expected
    # The next replacement works, and reads what was found.
    tables.replace_table(spark.read.table(name).where("symbol = 'A'"), name)
    assert by_key(spark.read.table(name)) == {k: v for k, v in expected.items() if k[0] == "A"}


def test_buckets_survive_a_repair(spark, monkeypatch, name, old, new):
    from barloom.operators import averages

    tables.replace_table(old, name)
    with monkeypatch.context() as patch:
        killed_at(patch, tables, "_create")
        with pytest.raises(Killed):
            tables.replace_table(new, name, buckets=4)
    assert not spark.catalog.tableExists(name)
    stored = Stages(spark).table(name)
    assert by_key(stored) == by_key(new)
    assert "Exchange" not in averages.average_ratio(stored)._jdf.queryExecution().executedPlan().toString()


def test_a_new_session_finds_the_table(spark, name, old):
    """The catalog of a session may be its own; the record isn't."""
    tables.replace_table(old, name)
    spark.sql(f"DROP TABLE {name}")
    assert by_key(landing.ensure_table(spark, name, schemas.BAR)) == by_key(old)
    tables.drop_table(spark, name)
    assert landing.ensure_table(spark, name, schemas.BAR).count() == 0


def test_of_two_writers_the_second_fails(spark, name, old, new):
    tables.replace_table(old, name)
    first, second = tables.staged(new, name), tables.staged(new.limit(1), name)
    tables.publish(spark, name, first)
    with pytest.raises(records.Conflict):
        tables.publish(spark, name, second)
    assert by_key(spark.read.table(name)) == by_key(new)


def test_old_versions_go_and_a_running_reader_keeps_its_own(spark, name, old, new):
    tables.replace_table(old, name)
    reader = spark.read.table(name)
    tables.replace_table(new, name)
    assert by_key(reader) == by_key(old)
    for _ in range(3):
        tables.replace_table(old, name)
    home = records.home(spark, name)

    def versions():
        return [x for x in storage.names_in(spark, home) if x.startswith("v-")]

    assert len(versions()) == tables.KEEP_VERSIONS == len(storage.names_in(spark, f"{home}/records"))
    tables.staged(new, name)  # never published
    records.vacuum(spark, name)
    assert len(versions()) == tables.KEEP_VERSIONS
    assert by_key(spark.read.table(name)) == by_key(old)


def test_a_managed_table_is_taken_over(spark, name, old, new):
    old.write.saveAsTable(name)
    tables.replace_table(new.union(spark.read.table(name)).dropDuplicates(["symbol", "date"]), name)
    assert spark.read.table(name).count() == 70
