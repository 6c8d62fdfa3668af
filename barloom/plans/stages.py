"""The daily job as stages over named tables.

Each stage reads catalog tables, composes operators and replaces its output tables;
nothing else passes between stages. With ``buckets`` the per-symbol tables are
bucketed and sorted, so that the window passes of later stages need no exchange. With ``yearly`` the
bars are also partitioned by year, and a daily merge rewrites the present year only.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import (
    averages,
    backtest,
    breakouts,
    directional,
    evaluate,
    features,
    indexes,
    ingest,
    mart,
    models,
    prices,
)
from barloom.operators.evaluate import Cell
from barloom.operators.models import Span
from barloom.plans.inputs import D
from barloom.sinks import tables
from barloom.sources import landing, ledger
from barloom.storage import materialize

NORMALIZED_SINCE = D(2000, 1, 1)
CALENDAR = "MSFT"
BENCHMARK = "SPX"
# A calendar this short cannot be right.
SHORTEST_CALENDAR = 100

UNIVERSE_TABLE = "index_SP500_list"
BARS, DELTA, CALENDAR_TABLE, BENCHMARK_TABLE = "eod2", "eod_delta", "eod_msft", "eod_spx"
FILES, TAKEN = "landed_files", "landed_files_taken"
CANDIDATES, NORMALIZED, ADJUSTED = "candidate", "eod_norm", "eod_adj"
INDEX, RELATIVE, RATIOS = "idx", "eod_rel", "eod_rlt"
DIRECTIONAL, UP, GAP_UP, MART = "ta_adx", "ta_upbreak", "ta_gupbreak", "ta_merge"
PREDICTIONS, HELD, EVALUATED, PUBLISHED = (
    "check_pred",
    "check_pred_buy_and_hold",
    "check_pred_ext",
    "predictions",
)

REGRESSED, REGRESSED_ENDS = "check_diff", "check_diff_ends"
SCORED = "predictions_scored"
RISING, BREADTH, PRICED = "points_rising", "breadth", "check_pred_price"

CLASSIFIER_SPAN = Span(D(2000, 4, 1), D(2015, 4, 1), D(2015, 4, 1), None)
HOLD_SPANS = [
    Span(D(2000, 10, 1), D(2015, 10, 1), D(2015, 10, 1), D(2016, 4, 1)),
    Span(D(2000, 4, 1), D(2015, 4, 1), D(2015, 4, 1), D(2016, 10, 1)),
]
FOREVER = D(9999, 4, 1)
SWEEP = [Cell(t / 10, D(2015, 4, 1), FOREVER) for t in range(5, 11)] + [
    Cell(0.6, D(2015 + m // 12, m % 12 + 1, 1), D(2015 + (m + 1) // 12, (m + 1) % 12 + 1, 1))
    for m in range(16, 2, -1)
]


def average_table(window: int) -> str:
    return f"ta_mat{window}_close"


def ratio_table(fast: int, slow: int) -> str:
    return f"ta_dual_{fast}_{slow}"


def trade_table(fast: int, slow: int) -> str:
    return f"trade_mat_duel_{fast}_{slow}"


def model_path(folder: str, span: Span, kind: str) -> str:
    return f"{folder}/{kind}-{span.start}-{span.train_end}-{span.check_start}"


class Stages:
    """The stages over one session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, yearly: bool = False):
        self.spark = spark
        self.buckets = buckets
        self.yearly = yearly

    def table(self, name: str) -> DataFrame:
        tables.recover(self.spark, name)
        stored = self.spark.read.table(name)
        return stored.drop(tables.PART) if name == BARS else stored

    def _replace(self, name: str, df: DataFrame) -> None:
        buckets = self.buckets if {"symbol", "date"} <= set(df.columns) else None
        tables.replace_table(df, name, buckets=buckets)

    # --- ingest

    def load_universe(self, path: str) -> None:
        self._replace(UNIVERSE_TABLE, landing.read_universe(self.spark, path))

    def refresh(self, name: str, symbol: str, path: str) -> None:
        """Reload the calendar or benchmark series; it must not lose rows."""
        old = landing.ensure_table(self.spark, name, schemas.BAR)
        new = materialize(landing.read_symbol_feed(self.spark, path, symbol), name)
        if not ingest.may_replace(old, new):
            raise ValueError(f"the reload of {name} has fewer rows than the table")
        self._replace(name, new)

    def find_candidates(self) -> None:
        calendar = self.table(CALENDAR_TABLE).where(F.col("symbol") == CALENDAR)
        landing.ensure_table(self.spark, BARS, schemas.BAR)
        bars = self.table(BARS)
        stale = ingest.candidates(self.table(UNIVERSE_TABLE), bars, calendar)
        self._replace(CANDIDATES, stale)

    def land(self, path: str) -> None:
        landed = landing.read_daily_feed(self.spark, path)
        self._replace(DELTA, ingest.new_bars(landed, self.table(CANDIDATES)))

    def take(self, path: str) -> None:
        """Make the delta of the landed files that were never merged; others aren't opened.

        Unlike ``land`` it takes every bar of a new file, older ones too. The files are noted after the merge: a
        run that ends before reads them again.
        """
        known = landing.ensure_table(self.spark, FILES, ledger.FILE)
        files = materialize(ledger.new_files(ledger.landed(self.spark, path), known), "files")
        # The delta first: files are never noted for a delta that hasn't their bars.
        self._replace(DELTA, ledger.read(self.spark, path, files))
        self._replace(TAKEN, files)

    def merge(self) -> None:
        """Merge the delta into the bars: with ``yearly`` only the years it falls in are read and written."""
        delta = self.table(DELTA)
        if self.yearly:
            tables.merge_partitions(delta, BARS, ingest.merge_bars, F.year("date"), self.buckets)
        else:
            self._replace(BARS, ingest.merge_bars(self.table(BARS), delta))  # beside the table it reads
        taken = landing.ensure_table(self.spark, TAKEN, ledger.FILE)
        if taken.head(1):
            ledger.note(taken, FILES)
            self._replace(TAKEN, taken.limit(0))

    def check(self) -> bool:
        """Whether few enough symbols lack bars of the calendar."""
        calendar = self.table(CALENDAR_TABLE).where(F.col("symbol") == CALENDAR)
        recent = calendar.where(F.col("date") >= F.lit(ingest.COMPLETE_SINCE))
        if recent.count() <= SHORTEST_CALENDAR:
            raise ValueError("the calendar is too short to check against")
        return ingest.completeness(self.table(BARS), calendar).first()["passed"]

    # --- prices

    def price(self) -> None:
        adjusted = prices.adjust(self.table(BARS), NORMALIZED_SINCE)
        self._replace(NORMALIZED, prices.normalize(adjusted))
        normalized = self.table(NORMALIZED)
        self._replace(INDEX, indexes.median_index(normalized))
        values = prices.benchmark_values(self.table(BENCHMARK_TABLE), BENCHMARK)
        self._replace(RELATIVE, prices.relative(normalized, values))

    def ratio(self) -> None:
        """Adjusted bars over the equal-weight mean index."""
        self._replace(ADJUSTED, prices.adjust(self.table(BARS)))
        index = indexes.mean_index(self.table(NORMALIZED))
        self._replace(RATIOS, prices.relative_ratios(self.table(ADJUSTED), index))

    # --- indicators

    def average(self, *windows: int) -> None:
        """One table per window, from one pass over the bars."""
        stored = materialize(
            averages.moving_averages(self.table(RELATIVE), windows), "moving_averages"
        )
        for window in windows:
            rows = stored.where(F.col("window") == window).drop("window")
            self._replace(average_table(window), rows)

    def indicate(self, fast: int = 8, slow: int = 20) -> None:
        relative, bars = self.table(RELATIVE), self.table(BARS)
        self.average(fast, slow)
        self._replace(ratio_table(fast, slow), averages.average_ratio(relative, fast, slow))
        self._replace(DIRECTIONAL, directional.directional_index(relative))
        self._replace(UP, breakouts.up_breakouts(bars))
        self._replace(GAP_UP, breakouts.gap_up_breakouts(bars))

    def build_mart(self, fast: int = 8, slow: int = 20) -> None:
        benchmark = self.table(BENCHMARK_TABLE)
        rows = mart.feature_mart(self.table(BARS), benchmark, fast, slow, NORMALIZED_SINCE)
        self._replace(MART, rows)

    def trade(
        self, fast: int = 14, slow: int = 200, since: datetime.date | None = backtest.SINCE
    ) -> DataFrame:
        """Write the crossover ledger and return its summary."""
        pairs = backtest.crossover(self.table(RELATIVE), fast, slow, since)
        self._replace(trade_table(fast, slow), backtest.ledger(pairs))
        return backtest.summary(self.table(trade_table(fast, slow)))

    # --- models

    def learn(
        self,
        window: int = 30,
        coach: int = 1,
        spans: Sequence[Span] = (CLASSIFIER_SPAN,),
        kind: str = "tree",
        keep: str | None = None,
    ) -> DataFrame:
        """Train and score spans; their scores replace the predictions of the run before.

        With ``keep`` each span's model is stored in that folder, for ``score``.
        """
        points = features.mart_features(self.table(MART), window, coach)
        stored = materialize(models.as_vectors(points), "points")
        for k, span in enumerate(spans):
            model, index = models.fit_span(stored, span, kind)
            if keep is not None:
                models.keep(model, model_path(keep, span, kind))
            scored = models.score_span(stored, span, model, index)
            tables.write_table(scored, PREDICTIONS, overwrite=k == 0)
        return self.table(PREDICTIONS)

    def score(
        self,
        date: datetime.date,
        keep: str,
        window: int = 30,
        coach: int = 1,
        span: Span = CLASSIFIER_SPAN,
        kind: str = "tree",
    ) -> DataFrame:
        """Score a date's points with the stored model of a span, without training; its partition of the scores is replaced."""
        points = features.mart_features(self.table(MART), window, coach)
        scored = models.score_date(models.as_vectors(points), date, *models.kept(model_path(keep, span, kind)))
        tables.write_partition(scored, SCORED, date.isoformat())
        return self.table(SCORED).where(F.col(tables.PART) == date.isoformat())

    def publish(self, date: datetime.date, k: int = 10) -> DataFrame:
        """Store the open predictions of a date as its partition of the published table; return the best."""
        current = evaluate.open_predictions(self.table(PREDICTIONS), date)
        tables.write_partition(current, PUBLISHED, date.isoformat())
        return current.limit(k)

    def regress(
        self,
        path: str,
        last_train: datetime.date,
        window: int = 180,
        coach: int = 30,
        k: int = 100,
        max_iter: int = 50,
        max_depth: int = 10,
    ) -> DataFrame:
        """Lag-ratio regression: points stored as libsvm text and scanned again, trees, both ends, errors.

        Writes the scores and their ``k`` best and worst; returns the two mean squared errors.
        """
        points = features.lag_ratio_points(
            features.marked_at(self.table(RELATIVE), last_train), window, coach, "part"
        )
        stored = materialize(models.as_vectors(points), "lag_points")
        parts = []
        for part in ("train", "check"):
            rows = stored.where(F.col("part") == part)
            tables.write_labeled_points(rows, f"{path}/{part}")
            parts.append(landing.read_labeled_points(self.spark, f"{path}/{part}", width=window))
        scored = models.regress(*parts, max_iter=max_iter, max_depth=max_depth)
        self._replace(REGRESSED, scored.select("label", "prediction"))
        self._replace(REGRESSED_ENDS, evaluate.both_ends(self.table(REGRESSED), "prediction", k, "label"))
        return evaluate.squared_errors(self.table(REGRESSED))

    def rise(self, fast: int = 8, slow: int = 20, window: int = 60, coach: int = 3) -> None:
        """Classification points over the stored ratio of averages."""
        ratio = self.table(ratio_table(fast, slow)).withColumnRenamed("mat_dual", "close")
        self._replace(RISING, features.rising_points(ratio, window, coach))

    def breadth(self, bars_back: int = 5) -> None:
        """How many symbols rose and fell over some bars, each day."""
        self._replace(BREADTH, indexes.breadth_over(self.table(RELATIVE), bars_back))

    def hold(self, window: int = 60, coach: int = 4, spans: list[Span] = HOLD_SPANS) -> None:
        points = features.forward_labels(self.table(MART), window, coach, unlabeled=-1)
        tables.write_table(models.buy_and_hold(points, spans), HELD)

    def evaluate(self, predictions: str = PREDICTIONS, cells: list[Cell] = SWEEP) -> DataFrame:
        """Write the enriched and the priced predictions and return the precision sweep over them."""
        relative = self.table(RELATIVE)
        enriched = evaluate.enrich(
            self.table(predictions),
            self.table(BARS),
            relative,
            self.table(BENCHMARK_TABLE),
            indexes.breadth_over(relative),
        )
        self._replace(EVALUATED, enriched)
        priced = evaluate.with_prices(
            self.table(predictions), self.table(BARS), self.table(BENCHMARK_TABLE)
        )
        self._replace(PRICED, priced)
        stored = self.table(EVALUATED)
        if evaluate.label_violations(stored).first()["violations"]:
            raise ValueError("predictions are labelled 1 although the relative close fell")
        return evaluate.precision_sweep(stored, cells)
