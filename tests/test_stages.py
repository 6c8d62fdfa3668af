"""The whole daily job over named tables, from feed files to the precision sweep."""

from __future__ import annotations

import datetime

import pytest
from helpers import day, frame, random_walk
from pyspark.sql import functions as F

from barloom.operators.evaluate import Cell
from barloom.operators.models import Span
from barloom.plans import stages as st
from barloom.sinks import tables

START = datetime.date(2013, 1, 1)
DAYS = 900


def write_feed(spark, rows, path):
    feed = frame(spark, rows).select(
        F.col("date").alias("Date"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "adjclose",
    )
    feed.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    symbols = ["AAA", "BBB", "CCC"]
    walks = {s: random_walk(s, DAYS, start=START) for s in [*symbols, "MSFT", "SPX"]}
    universe = spark.createDataFrame(
        [(s, f"X/{s}", s.title(), "Sector") for s in symbols],
        "ticker string, code string, name string, sector string",
    )
    tables.write_universe(universe, str(root / "universe"))
    for name in ["MSFT", "SPX"]:
        write_feed(spark, walks[name], str(root / name))
    landed = [r for s in symbols for r in walks[s]]
    tables.write_daily_feed(frame(spark, landed), str(root / "feed"))

    job = st.Stages(spark, buckets=4)
    job.load_universe(str(root / "universe"))
    job.refresh(st.CALENDAR_TABLE, "MSFT", str(root / "MSFT"))
    job.refresh(st.BENCHMARK_TABLE, "SPX", str(root / "SPX"))
    job.root = root
    return job


def test_ingest_loads_everything_once(spark, job):
    job.find_candidates()
    assert spark.table(st.CANDIDATES).count() == 3
    job.land(str(job.root / "feed"))
    job.merge()
    # The calendar's first date counts as loaded, so bars start on the day after.
    assert spark.table(st.BARS).count() == 3 * (DAYS - 1)
    job.find_candidates()
    assert spark.table(st.CANDIDATES).count() == 0
    job.land(str(job.root / "feed"))
    assert spark.table(st.DELTA).count() == 0
    job.merge()
    assert spark.table(st.BARS).count() == 3 * (DAYS - 1)
    assert job.check()


def test_refresh_refuses_a_shorter_series(spark, job):
    write_feed(spark, random_walk("SPX", 10, start=START), str(job.root / "short"))
    with pytest.raises(ValueError):
        job.refresh(st.BENCHMARK_TABLE, "SPX", str(job.root / "short"))
    assert spark.table(st.BENCHMARK_TABLE).count() == DAYS


def test_prices_and_indicators(spark, job):
    job.price()
    job.ratio()
    job.indicate()
    job.average(14, 200)
    bars = 3 * (DAYS - 1)
    assert spark.table(st.NORMALIZED).count() == bars
    assert spark.table(st.RELATIVE).count() == bars
    assert spark.table(st.RATIOS).count() == bars
    assert spark.table(st.INDEX).count() <= DAYS
    assert spark.table("ta_mat8_close").count() == bars
    assert spark.table("ta_mat200_close").where("close_mat > 0").count() == 3 * (DAYS - 200)
    assert spark.table("ta_dual_8_20").count() == 3 * (DAYS - 20)
    assert spark.table(st.DIRECTIONAL).where("adx > 0").count() == 3 * (DAYS - 28)


def test_mart_rows_are_those_of_the_stored_indicators(spark, job):
    """Each mart row looked up in plain dictionaries of the stored tables."""
    job.build_mart()

    def stored(name, column):
        return {(r["symbol"], r["date"]): r[column] for r in spark.table(name).collect()}

    closes, ratios = stored(st.RELATIVE, "close"), stored("ta_dual_8_20", "mat_dual")
    strengths, gaps = stored(st.DIRECTIONAL, "adx"), stored(st.GAP_UP, "label")
    opens = {r["date"]: r["open"] for r in spark.table(st.BENCHMARK_TABLE).collect()}
    rows = spark.table(st.MART).collect()
    wanted = {k for k in closes if ratios.get(k, -1) > 0 and strengths.get(k, -1) > 0}
    assert {(r["symbol"], r["date"]) for r in rows} == wanted
    assert len(rows) == len(wanted) == 3 * (DAYS - 28)
    for r in rows:
        key = (r["symbol"], r["date"])
        assert r["close"] == pytest.approx(closes[key])
        assert r["mat_dual"] == pytest.approx(ratios[key])
        assert r["adx"] == pytest.approx(strengths[key], abs=2e-4)
        assert r["gupbreak"] == gaps.get(key)
        assert r["spxopen"] == opens[r["date"]]


def test_trade(spark, job):
    summary = job.trade(since=day("2013-01-01")).collect()
    assert {r["symbol"] for r in summary} == {"AAA", "BBB", "CCC"}
    assert spark.table("trade_mat_duel_14_200").count() == 3 * (DAYS - 200)


def test_learn_hold_and_evaluate(spark, job):
    job.learn(window=5, coach=2)
    scored = spark.table(st.PREDICTIONS)
    first = scored.count()
    job.learn(window=5, coach=2)  # a second run replaces the first
    scored = spark.table(st.PREDICTIONS)
    assert scored.count() == first > 0
    assert scored.where("prob is null").count() == 0
    last = scored.agg(F.max("date2")).first()[0]
    for _ in range(2):
        assert job.publish(last).count() == 3
        assert spark.table(st.PUBLISHED).count() == 3
    job.publish(datetime.date(1999, 1, 1))
    assert spark.table(st.PUBLISHED).where(F.col("par") == last.isoformat()).count() == 3
    cells = [Cell(0.0, day("2015-04-01"), st.FOREVER), Cell(0.5, day("2015-04-01"), st.FOREVER)]
    swept = job.evaluate(cells=cells).collect()
    labelled = scored.where("is_labeled = 1").count()
    assert {r["threshold"]: r["all"] for r in swept}[0.0] == labelled
    assert spark.table(st.EVALUATED).count() == labelled
    assert spark.table(st.PRICED).count() == scored.count()
    spans = [Span(day("2013-01-01"), day("2015-01-01"), day("2015-01-01"), day("2016-01-01"))]
    job.hold(window=5, coach=2, spans=spans)
    assert spark.table(st.HELD).where("prob = 1.0").count() == spark.table(st.HELD).count() > 0


def test_a_kept_model_scores_a_date_without_training(spark, job, monkeypatch):
    folder = str(job.root / "models")
    job.learn(window=5, coach=2, keep=folder)
    last = spark.table(st.PREDICTIONS).agg(F.max("date2")).first()[0]
    learned = {r["symbol"]: r["prob"] for r in spark.table(st.PREDICTIONS).where(F.col("date2") == F.lit(last)).collect()}
    monkeypatch.setattr(st.models, "fit_span", None)
    for _ in range(2):
        scored = job.score(last, folder, window=5, coach=2)
        assert {r["symbol"]: r["prob"] for r in scored.collect()} == learned and len(learned) == 3


def test_regression_rise_and_breadth(spark, job):
    for _ in range(2):
        errors = job.regress(str(job.root / "points"), day("2014-06-30"), window=8, coach=3, k=5, max_iter=2, max_depth=3)
        row = errors.first()
        assert 0 <= row["mse"] and 0 <= row["naive_mse"] < 1
        assert spark.table(st.REGRESSED_ENDS).groupBy("end").count().count() == 2
        assert spark.table(st.REGRESSED_ENDS).count() == 10
        job.rise(window=5)
        assert {r["label"] for r in spark.table(st.RISING).select("label").distinct().collect()} == {0.0, 1.0}
        job.breadth()
        assert spark.table(st.BREADTH).where("pos + neg > 3").count() == 0


def test_a_failing_write_leaves_the_old_table(spark, job):
    before = spark.table(st.BARS).count()
    broken = spark.table(st.BARS).withColumn("close", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.replace_table(broken, st.BARS, buckets=4)
    assert spark.table(st.BARS).count() == before
    job.merge()
    assert spark.table(st.BARS).count() == before


def test_a_switch_that_was_cut_off_is_finished(spark, job):
    before = spark.table(st.BARS).count()
    spark.sql(f"ALTER TABLE {st.BARS} RENAME TO {st.BARS}{tables.BESIDE}")
    assert job.table(st.BARS).count() == before
