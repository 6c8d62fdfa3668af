"""Derived inputs shared by the registered queries. Nothing here is computed until used."""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import evaluate, features, indexes, mart, models, prices
from barloom.operators.models import Span
from barloom.sources import market

D = datetime.date

DELTA_FROM = D(2000, 12, 1)
HISTORY_UNTIL = D(2001, 1, 1)
LAST_TRAIN = D(1998, 6, 30)
SPANS = [
    Span(D(1995, 4, 1), D(1999, 1, 1), D(1999, 1, 1), D(2001, 6, 1)),
    Span(D(1995, 10, 1), D(1999, 6, 1), D(1999, 6, 1), D(2002, 1, 1)),
]
OPEN_SPAN = Span(D(1995, 4, 1), D(1999, 1, 1), D(1999, 1, 1), None)


class Inputs:
    """Frames derived from the tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def stored(self) -> Inputs:
        """The same inputs over stored bars and benchmark, for what reads them several times."""
        other = Inputs(self.spark, self.folder)
        other.bars = storage.materialize(self.bars, "bars")
        other.benchmark = storage.materialize(self.benchmark, "benchmark")
        return other

    @cached_property
    def bars(self) -> DataFrame:
        return market.bars(self.spark, self.folder)

    @cached_property
    def benchmark(self) -> DataFrame:
        return market.benchmark(self.spark, self.folder)

    @cached_property
    def universe(self) -> DataFrame:
        return market.universe(self.spark, self.folder)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.bars.select("date").distinct()

    @cached_property
    def history(self) -> DataFrame:
        return market.bars(self.spark, self.folder, before=HISTORY_UNTIL)

    @cached_property
    def delta(self) -> DataFrame:
        late = market.bars(self.spark, self.folder, since=DELTA_FROM)
        return late.withColumn("volume", F.col("volume") + 1)

    @cached_property
    def adjusted(self) -> DataFrame:
        return prices.adjust(self.bars)

    @cached_property
    def normalized(self) -> DataFrame:
        return prices.normalize(self.adjusted)

    @cached_property
    def relative(self) -> DataFrame:
        return prices.relative(self.adjusted, prices.benchmark_values(self.benchmark))

    @cached_property
    def rated(self) -> DataFrame:
        return mart.rated_bars(self.bars, self.benchmark)

    @cached_property
    def held(self) -> DataFrame:
        """Buy-and-hold predictions with a spread of probabilities, for the evaluations."""
        points = features.forward_labels(self.rated, window=60, coach=4, unlabeled=-1)
        rows = models.buy_and_hold(points, SPANS)
        return rows.withColumn("prob", (F.dayofyear("date2") % 10) / 10.0)

    @cached_property
    def partly_loaded(self) -> DataFrame:
        """History in which some symbols were never loaded, some are current and the rest is stale."""
        loaded = F.substring("symbol", 2, 9).cast("int") % 7 != 0
        return self.history.where(loaded)

    @cached_property
    def loaded_days(self) -> DataFrame:
        return self.history.select("date").distinct()

    @cached_property
    def enriched(self) -> DataFrame:
        breadth = indexes.breadth_over(self.relative)
        return evaluate.enrich(self.held, self.bars, self.relative, self.benchmark, breadth)
