from __future__ import annotations

import datetime

import pytest
from helpers import by_key, day, frame, random_walk
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import ingest
from barloom.sinks import tables
from barloom.sources import landing


def bar(symbol, date, **values):
    base = {"open": 1.0, "high": 1.5, "low": 0.5, "close": 1.2, "volume": 1000.0, "adjclose": 1.2}
    return {"symbol": symbol, "date": day(date), **base, **values}


@pytest.fixture()
def bars(spark):
    return frame(
        spark,
        [
            bar("AAA", "2016-01-01"),
            bar("AAA", "2016-01-02"),
            bar("MSFT", "2016-01-01"),
            bar("MSFT", "2016-01-03"),
        ],
    )


@pytest.fixture()
def calendar(bars):
    return bars.where(F.col("symbol") == "MSFT")


def tickers(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def test_date_spans_have_one_row_per_ticker(spark, bars):
    spans = ingest.date_spans(tickers(spark, "MSFT", "AAA"), bars)
    assert spans.count() == 2


def test_calendar_bounds(calendar):
    bounds = ingest.calendar_bounds(calendar).first()
    assert (bounds["min_date"], bounds["max_date"]) == (day("2016-01-01"), day("2016-01-03"))
    assert ingest.latest_date(calendar).first()["date"] == day("2016-01-03")


def test_candidates_drop_current_symbols_and_start_new_ones(spark, bars, calendar):
    found = ingest.candidates(tickers(spark, "MSFT", "AAA"), bars, calendar)
    assert [r["symbol"] for r in found.collect()] == ["AAA"]
    found = ingest.candidates(tickers(spark, "MSFT", "AAA", "BIDU"), bars, calendar)
    rows = {r["symbol"]: (r["max_date"], r["min_date"]) for r in found.collect()}
    assert rows == {
        "AAA": (day("2016-01-02"), day("2016-01-01")),
        "BIDU": (day("2016-01-01"), day("2016-01-01")),
    }


def test_new_bars_start_the_day_after(spark, bars):
    stale = spark.createDataFrame(
        [("AAA", day("2016-01-01"), day("2016-01-01"))], schemas.CANDIDATE
    )
    assert [r["date"] for r in ingest.new_bars(bars, stale).collect()] == [day("2016-01-02")]


def test_merge_prefers_the_delta(spark, bars):
    delta = frame(
        spark,
        [
            bar("AAA", "2016-01-02", volume=7.0),
            bar("AAA", "2016-01-03"),
            bar("OLD", "1899-12-31"),
            bar(None, "2016-01-01"),
        ],
    )
    merged = by_key(ingest.merge_bars(bars, delta))
    assert len(merged) == 5
    assert merged[("AAA", day("2016-01-02"))]["volume"] == 7.0
    assert merged[("AAA", day("2016-01-01"))]["volume"] == 1000.0


def test_merge_combines_copies_of_a_hot_key(spark):
    """A third of all rows share one key; they leave the map side as one row per task."""
    hot = spark.range(20000).select(
        F.lit("HOT").alias("symbol"),
        F.lit(day("2016-01-01")).alias("date"),
        *[(F.col("id") % 97).cast("double").alias(name) for name in schemas.BAR_VALUES],
    )
    cold = spark.range(40000).select(
        F.concat(F.lit("S"), F.col("id") % 200).alias("symbol"),
        F.date_add(F.lit(day("2000-01-01")), (F.col("id") / 200).cast("int")).alias("date"),
        *[F.lit(1.0).alias(name) for name in schemas.BAR_VALUES],
    )
    once = ingest.one_bar_per_day(hot.unionByName(cold))
    assert once.count() == 40001
    kept = once.where(F.col("symbol") == "HOT").collect()
    assert len(kept) == 1
    # All values come from the same copy, and a second run keeps the same one.
    assert len({kept[0][name] for name in schemas.BAR_VALUES}) == 1
    again = ingest.one_bar_per_day(hot.repartition(7)).collect()
    assert again[0]["open"] == kept[0]["open"]


def test_coverage_is_in_symbol_order(bars):
    rows = [tuple(r) for r in ingest.coverage(bars).collect()]
    assert rows == [("AAA", day("2016-01-02"), 2), ("MSFT", day("2016-01-03"), 2)]


def test_completeness(spark):
    full, short = random_walk("FULL", 50), random_walk("SHORT", 49)
    bars = frame(spark, full + short)
    calendar = frame(spark, full)
    since = datetime.date(1990, 1, 1)
    assert [r["symbol"] for r in ingest.short_symbols(bars, calendar, since).collect()] == ["SHORT"]
    assert ingest.completeness(bars, calendar, since, allowed=1).first()["passed"]
    assert not ingest.completeness(bars, calendar, since, allowed=0).first()["passed"]


def test_refresh_must_not_shrink(spark, bars, calendar, tmp_path):
    fresh = ingest.refresh(calendar, bars, str(tmp_path / "a"))
    assert fresh.count() == 4
    with pytest.raises(ValueError):
        ingest.refresh(bars, calendar, str(tmp_path / "b"))


def test_slice_and_calendar_parts(bars):
    kept = ingest.bar_slice(bars, "AAA", day("2016-01-02"), day("2016-01-31"))
    assert by_key(kept).keys() == {("AAA", day("2016-01-02"))}
    spark = bars.sparkSession
    dates = spark.createDataFrame([(day("2016-04-21"),), (day("2016-12-31"),)], "date date")
    parts = {r["date"]: r for r in ingest.calendar_parts(dates).collect()}
    assert parts[day("2016-04-21")]["weekday"] == 3
    assert parts[day("2016-12-31")]["next_day"] == day("2017-01-01")


def test_daily_feed_leaves_bad_lines_out(spark, tmp_path):
    folder = tmp_path / "feed" / "symbol=0012"
    folder.mkdir(parents=True)
    (folder / "part.csv").write_text(
        "Date,Open,High,Low,Close,Volume,AdjClose\n"
        "2016-01-04, 1.0 ,2.0,0.5,1.5,100,1.4\n"
        "2016-01-05,1.0,2.0,0.5,1.5,100\n"
        "2016-01-06,1.0,n/a,0.5,1.5,100,1.4\n"
        "<html>error</html>\n"
        "2016-01-07,1.0,2.0,0.5,1.5,100,1.4,9\n"
    )
    bars = landing.read_daily_feed(spark, str(tmp_path / "feed"))
    assert bars.schema == schemas.BAR
    assert by_key(bars).keys() == {("0012", day("2016-01-04"))}
    assert bars.count() == 1
    assert landing.rejected_lines(spark, str(tmp_path / "feed")).count() == 4


def test_daily_feed_roundtrip(spark, tmp_path):
    bars = frame(spark, random_walk("A", 20) + random_walk("B", 20))
    tables.write_daily_feed(bars, str(tmp_path / "feed"))
    assert by_key(landing.read_daily_feed(spark, str(tmp_path / "feed"))) == by_key(bars)


def test_bar_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("A, 2016-01-04,1,2,0.5,1.5,100,1.4\nA,2016-01-05,1,2\nA,x,1,2,0.5,1.5,100,1.4\n")
    assert by_key(landing.read_bar_lines(spark, str(path))).keys() == {("A", day("2016-01-04"))}


def test_universe_list_has_bare_carriage_returns(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("ticker,code,name,sector\rA,X/A,Agilent,Health\rB,X/B,Barnes,Gold\r", newline="")
    raw = landing.read_universe(spark, str(path))
    tables.write_tsv(raw, str(tmp_path / "tsv"), files=1)
    stored = landing.read_tsv(spark, str(tmp_path / "tsv"), schemas.UNIVERSE)
    assert sorted(r["ticker"] for r in stored.collect()) == ["A", "B"]
    assert stored.where(F.col("ticker") == "B").first()["sector"] == "Gold"


def test_empty_table_is_made_once(spark):
    spark.sql("DROP TABLE IF EXISTS fresh_bars")
    assert landing.ensure_table(spark, "fresh_bars", schemas.BAR).count() == 0
    frame(spark, random_walk("A", 3)).write.mode("append").saveAsTable("fresh_bars")
    assert landing.ensure_table(spark, "fresh_bars", schemas.BAR).count() == 3
